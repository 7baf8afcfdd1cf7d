"""Benchmark decontamination by greedy string tiling.

Words (lower case, letters and digits) of a document are joined with the benchmark by runs of SEED words. Items whose words could be
covered enough by the shared runs are tiled: the longest non-overlapping matches are marked first, found by running Karp-Rabin
hashes over what is still unmarked, until no match of SEED words is left. The share of an item's words under tiles is its
coverage; since tiles may lie in any order, reordered passages count too.

The benchmark is the stated query set. It is handed to the tasks as blocks of at most BLOCK_WORDS words, so what is broadcast has a
fixed bound; a larger benchmark takes more passes over the documents. Documents are only read and never shuffled.

Edge cases: null or empty texts and items match nothing; an item shorter than SEED words is one whole run; repeated rows of
documents are judged alike; repeated items count once each; other columns are left alone. No benchmark: nothing is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import map_arrow, mix, powers, ship

SEED, COVERAGE, BLOCK_WORDS = 5, 0.8, 2_000_000
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` ids, each from the one before by one step of a running sum."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(len(ids))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(7)) * up[:len(ids)])])
    return mix((total[size:] - total[:-size]) * down[:len(ids) + 1 - size])


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy tiles of at least `least` ids."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), 32))
    while True:
        open_i = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_i, size).all(axis=1)) if len(item) >= size else np.zeros(0, int)
        open_t = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_t, size).all(axis=1)) if len(text) >= size else np.zeros(0, int)
        matches, longest = [], 0
        if len(open_i) and len(open_t):
            hash_i, hash_t = _windows(item, size)[open_i], _windows(text, size)[open_t]
            order = np.argsort(hash_i, kind="stable")
            lo, hi = np.searchsorted(hash_i[order], hash_t, "left"), np.searchsorted(hash_i[order], hash_t, "right")
            before: set[tuple[int, int]] = set()
            for k in np.flatnonzero(hi > lo):
                t = int(open_t[k])
                here = set()
                for i in open_i[order[lo[k]:hi[k]]].tolist():
                    here.add((i, t))
                    if (i - 1, t - 1) in before:
                        continue  # inside the match that began one word earlier
                    n = 0
                    while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                        n += 1
                    if n >= size:
                        matches.append((n, i, t))
                        longest = max(longest, n)
                before = here
        if longest > 2 * size:
            size = longest
            continue
        marked = False
        for n, i, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_i[i:i + n].all() and free_t[t:t + n].all():
                free_i[i:i + n] = free_t[t:t + n] = False
                found.append((i, t, n))
                marked = True
        if size > least:
            size = max(least, size // 2)
        elif not marked:  # at the least size, parts that other tiles cut off are looked for again
            return found


def _index(items: list[tuple[int, str]], seed: int) -> dict:
    """Word numbers and, by hash, where each run of `seed` words stands in the block of items."""
    vocab: dict[str, int] = {}
    texts, hashes, places, owners = [], [], [], []
    at = 0
    for number, (_, text) in enumerate(items):
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(text)], np.int64)
        size = min(seed, len(ids))
        texts.append(ids)
        if size:
            h = _windows(ids, size)
            hashes.append(h)
            places.append(np.arange(len(h)) + at)
            owners.append(np.full(len(h), number))
        at += len(ids)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    h = join(hashes, np.uint64)
    order = np.argsort(h, kind="stable")
    sizes = sorted({min(seed, len(t)) for t in texts if len(t)})
    return {"vocab": vocab, "texts": texts, "hash": h[order], "place": join(places, np.int64)[order], "owner": join(owners, np.int64)[order],
            "first": np.cumsum([0, *[len(t) for t in texts]])[:-1], "ids": [i for i, _ in items], "sizes": sizes}


def _search(shared, seed: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get, lengths = index["vocab"].get, np.array([len(t) for t in index["texts"]])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([get(w, -1) for w in words_of(text.as_py())], np.int64)
                for item in _hits(ids, index, lengths, seed, least):
                    found = tiles(index["texts"][item], ids, min(seed, int(lengths[item])))
                    share = sum(n for _, _, n in found) / int(lengths[item])
                    if share >= least:
                        out.append((doc, index["ids"][item], share, len(found)))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["doc_id", "item_id", "coverage", "tiles"])

    return run


def _hits(ids: np.ndarray, index: dict, lengths: np.ndarray, seed: int, least: float) -> list[int]:
    """Items whose words under shared runs reach the wanted share: no tiling can cover more."""
    if not len(ids):
        return []
    covered = []
    strange = np.concatenate([[0], np.cumsum(ids < 0)])
    for size in index["sizes"]:
        known = np.flatnonzero(strange[size:] == strange[:-size])
        if not len(known):
            continue
        h = np.unique(_windows(ids, size)[known])
        lo, hi = np.searchsorted(index["hash"], h, "left"), np.searchsorted(index["hash"], h, "right")
        n = hi - lo
        if not n.sum():
            continue
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = rows[np.minimum(lengths[index["owner"][rows]], seed) == size]
        covered.append((index["place"][rows][:, None] + np.arange(size)).reshape(-1))
    if not covered:
        return []
    places = np.unique(np.concatenate(covered))
    owner = np.searchsorted(index["first"], places, "right") - 1
    items, counts = np.unique(owner, return_counts=True)
    return [int(i) for i in items[counts >= least * lengths[items]]]


def _indexes(benchmark: DataFrame, seed: int) -> Iterator:
    """The benchmark's items as broadcast indexes of about BLOCK_WORDS words."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    counted = items.withColumn("n", F.size(F.split("text", r"\s+")).cast("long"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    blocks = int(total // (BLOCK_WORDS // 2)) + 1
    for b in range(blocks):
        own = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()]
        yield benchmark.sparkSession.sparkContext.broadcast(_index(own, seed))


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of every benchmark item that a document covers by `least` of its words."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return reduce(DataFrame.unionByName, [texts.mapInArrow(_search(shared, seed, least), "doc_id long, item_id long, coverage double, tiles int") for shared in _indexes(benchmark, seed)])


def _without(shared, seed: int, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(shared, seed, least)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for found in search(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])])):
                keep[found.column(0).to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = COVERAGE) -> DataFrame:
    """`docs` without the rows that hold a benchmark item. Every row is judged by its own text and carried through the search, so null and
    repeated ids make no difference and nothing is joined."""
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    left = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for shared in _indexes(benchmark, seed):
        left = map_arrow(left, _without(shared, seed, least, docs.columns.index("text")), schema)
    return left.toDF(*docs.columns)
