"""Helpers the operators of this folder share: inputs, scratch folders, word hashes and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.session import cut_lineage, ensure_checkpoint_dir

PIECE_BYTES = 1 << 20
MASK = (1 << 64) - 1
ROOT = 0x9E3779B97F4A7C15


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table of the shared folder and read back: a fraction of a checkpoint's bytes for columns of numbers."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once a session; Spark itself copies the archive to the executors."""
    context = spark.sparkContext
    if getattr(context, "_sievestone_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / "sievestone.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sievestone_shipped = True


def _giving_back(function: Callable) -> Callable:
    """`function`, after which the Python worker returns freed memory to the system: it waits for its next task beside JVM stages."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(_giving_back(function), schema)


def group_arrow(df: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """`function` of the Arrow table of all rows of each `key`."""
    ship(df.sparkSession)
    each = _giving_back(lambda tables: map(function, tables))
    return df.groupBy(key).applyInArrow(lambda table: list(each([table]))[0], schema)


def map_pandas(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(_giving_back(function), schema)


def digest(column) -> F.Column:
    """Lowercase hex SHA-256 of a text or binary column."""
    return F.sha2(column, 256)


# ---------------------------------------------------------------- texts as bytes

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, len + 1 borders) of an Arrow text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset:column.offset + len(column) + 1] if borders else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[borders[0]:borders[-1]], borders - borders[0]


def slices(batch: pa.RecordBatch, column: int, size: int = 4 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, or one longer text, so that working memory doesn't follow the batch."""
    borders = text_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(ROOT) + np.uint64(seed)) | np.uint64(1)


_BYTE_VALUES = mix(np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64) * np.uint64(ROOT))  # A-Z as a-z
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = ROOT | 1
        size = max(n, 2 * PIECE_BYTES)
        step = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x & MASK, np.uint64)]))
        _POWERS[:] = [step(base), step(pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _pieces(borders: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that end between texts or, inside longer texts, at white space."""
    start, end = 0, int(borders[-1])
    while start < end:
        stop = int(borders[np.searchsorted(borders, start + PIECE_BYTES, "right") - 1])
        if stop <= start:
            own = int(borders[np.searchsorted(borders, start, "right")])
            stop = start + PIECE_BYTES
            while stop < own and not _SPACE[data[stop]]:
                stop += 1
            stop = min(stop, own)
        yield start, stop
        start = stop


def word_hashes(data: np.ndarray, borders: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (longest runs of bytes other than x20 and x09-x0D, A-Z lower-cased) and the text it is in.
    `between` marks other bytes that stand between words; white space must be among them.

    The hash is a polynomial over the word's bytes, taken from running sums, so texts are never split in Python.
    """
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, stop in _pieces(borders, data):
        own = data[start:stop]
        up, down = powers(len(own))
        free = between[own]
        edge = np.zeros(len(own) + 1, bool)
        cuts = borders[(borders >= start) & (borders <= stop)] - start
        edge[cuts] = True
        edge[[0, -1]] = True
        word = ~free
        begin = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], free[:-1]])))
        end = np.flatnonzero(word & (edge[1:] | np.concatenate([free[1:], [True]]))) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[own] * up[:len(own)])])
        hashes.append(mix((total[end] - total[begin]) * down[begin]))
        owners.append(np.searchsorted(borders, begin + start, "right") - 1)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_hashes(words: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position of the first word) of every run of `size` words; a text with fewer words is one shorter run."""
    weights = odd_numbers(size, size)
    n = len(words)
    whole = np.zeros(0, np.int64)
    if n >= size:
        whole = np.flatnonzero(owners[:n - size + 1] == owners[size - 1:])
    value = np.zeros(len(whole), np.uint64)
    for k in range(size):
        value = value + words[whole + k] * weights[k]
    value = mix(value)
    texts, first, counts = np.unique(owners, return_index=True, return_counts=True)
    short = counts < size
    tails = np.array([sum(int(words[f + k]) * int(weights[k]) for k in range(c)) + int(c) & MASK for f, c in zip(first[short], counts[short])], np.uint64)
    value = np.concatenate([value, mix(tails)])
    owner = np.concatenate([owners[whole], texts[short]])
    position = np.concatenate([whole, first[short]])
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order], position[order]


# ---------------------------------------------------------------- connected components

#: Nodes with more links than this and than one in HUBS of all links join in several parts; there are fewer than HUBS of them.
HUB_LINKS, HUBS = 256, 10_000
#: A step over few links takes a few tasks, not one for every shuffle partition in each of its shuffles; more links take more tasks.
LINKS_A_TASK, LEAST_TASKS = 20_000, 8


def _with_lowest(both: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """`both` (a, b) joined to `low` (a, m, n). A hub's rows are dealt to parts by their other end, its minimum goes to every part; the hubs'
    names (fewer than HUBS) are broadcast."""
    most = max(HUB_LINKS, 2 * links // HUBS)
    parts = F.ceil(F.col("n") / most).cast("int")
    hubs = F.broadcast(low.filter(F.col("n") > most).select("a", parts.alias("parts")))
    dealt = both.join(hubs, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).cast("int").alias("part"))
    return dealt.join(low.select("a", "m", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part")), ["a", "part"]).drop("part")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over `links` (a, b); nodes without links are absent.

    Alternating stars: every node hands its larger neighbours to its smallest one, then its smaller ones too, until only
    stars are left. Each step is grouping and equality joins in as many tasks as the links need; nothing but two numbers a step reaches the
    driver.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(pairs)
    if not before[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        few = lambda df: df.coalesce(max(LEAST_TASKS, before[0] // LINKS_A_TASK))  # noqa: E731, B023
        pairs = few(pairs)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = few(few(_with_lowest(both, low, before[0])).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = few(large.join(low, "a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
        pairs = cut_lineage(few(small.select("p.a", "p.b").filter("a <> b").distinct()))
        after = sign(pairs)
        if after == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
