"""Token ids in binary shards of bit planes.

A shard file holds the ids of consecutive documents, cut into blocks of a fixed number of ids. Each block is transposed into bit
planes (or byte planes), each plane is compressed with zstandard, and a chunk index says where every plane begins:

    "BPLN" | version u8 | plane kind u8 | id bits u8 | 0 | block ids u32 | ids u64 | documents u32 | blocks u32
    per document: doc_id i64, ids u32
    per block and plane: size of the compressed plane u32
    the planes, block after block

All numbers are little-endian. Shards follow each other by doc_id: documents are range-partitioned by doc_id and sorted inside, every
partition writes shards of bounded size, and the shard's name is its rank. A reader adds up the ids of the shards before it.

Files are written by Spark's text writer, one row (a whole shard) a file, so only Spark touches the shared folder.

Edge cases: null and empty texts are just the end id; null doc_id sorts first; repeated rows are all written, in the order of their
texts; an empty table gives no documents.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievestone.llm.shared import map_arrow, scratch, ship, slices
from sievestone.llm.words import MARKS, WordIds, in_order

MAGIC, VERSION, BLOCK_IDS, SHARD_IDS, NO_ID = b"BPLN", 1, 1 << 16, 1 << 21, -(1 << 63)
BATCH_BYTES = 6 << 20
HEAD = struct.Struct("<4sBBBBIQII")


def to_planes(ids: np.ndarray, kind: str, bits: int) -> list[bytes]:
    """A block of ids as planes: plane k holds bit (or byte) k of every id."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [np.ascontiguousarray(data[k]).tobytes() for k in range((bits + 7) // 8)]
    return [np.packbits((data[k // 8] >> (k % 8)) & 1).tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    data = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        if kind == "byte":
            data[k] = np.frombuffer(plane, np.uint8)
        else:
            data[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return np.ascontiguousarray(data.T).view("<u4").reshape(-1)


def write_shard(docs: list[int | None], counts: list[int], ids: np.ndarray, kind: str = "bit", level: int = 1) -> bytes:
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=level).compress
    planes = [pack(p) for at in range(0, len(ids), BLOCK_IDS) for p in to_planes(ids[at:at + BLOCK_IDS], kind, bits)]
    table = np.zeros(len(docs), [("doc", "<i8"), ("n", "<u4")])
    table["doc"], table["n"] = [NO_ID if d is None else d for d in docs], counts
    head = HEAD.pack(MAGIC, VERSION, kind == "byte", bits, 0, BLOCK_IDS, len(ids), len(docs), -(-len(ids) // BLOCK_IDS))
    return b"".join([head, table.tobytes(), np.array([len(p) for p in planes], "<u4").tobytes(), *planes])


def read_shard(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of a shard, block by block."""
    magic, version, byte, bits, _, block, total, n_docs, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a shard of bit planes")
    at, kind = HEAD.size, "byte" if byte else "bit"
    table = np.frombuffer(data, [("doc", "<i8"), ("n", "<u4")], n_docs, at)
    at += table.nbytes
    per_block = (bits + 7) // 8 if byte else bits
    index = np.frombuffer(data, "<u4", n_blocks * per_block, at).astype(np.int64)
    starts = at + 4 * len(index) + np.concatenate([[0], np.cumsum(index)])
    unpack, held, number = zstandard.ZstdDecompressor().decompress, np.zeros(0, "<u4"), 0
    for doc, n in zip(table["doc"].tolist(), table["n"].tolist()):
        parts = [held]
        have = len(held)
        while have < n:
            planes = [unpack(data[starts[k]:starts[k + 1]]) for k in range(number * per_block, (number + 1) * per_block)]
            parts.append(from_planes(planes, min(block, total - number * block), kind))
            have += len(parts[-1])
            number += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield None if doc == NO_ID else doc, held[:n]
        held = held[n:]


class Tokens:
    """Ids of texts by a tokenizer file, as its library gives them. Words are encoded once (`words`): new words of letters, also with a mark at
    the end, in one call, joined by spaces, as each begins with the only token that starts with a space. A text that holds an added token is
    encoded whole, since the library finds those before it cuts anything."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every word comes once
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]  # how the vocabulary writes a space
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(space)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordIds(self.after_space, self.each)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def after_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([w.isalpha() or (w[-1] in MARKS and w[:-1].isalpha()) for w in words], bool)
        parts = [self.joined([w for w, p in zip(words, plain) if p]), self.each([" " + w for w, p in zip(words, plain) if not p])]
        return in_order(parts, ~plain)

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, _ = self.each([" " + " ".join(words)])
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            return self.each([" " + w for w in words])
        return ids, np.diff(np.append(starts, len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, len + 1 borders)."""
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.words.encode(texts)
        ids, borders = self.words.encode(pc.if_else(pa.array(whole), "", texts))
        parts = [(ids, np.diff(borders)[~whole]), self.each([texts[int(i)].as_py() for i in np.flatnonzero(whole)])]
        ids, sizes = in_order(parts, whole)
        return ids, np.concatenate([[0], np.cumsum(sizes)])


_TOKENS: dict[int, Tokens] = {}


def _tokens(shared) -> Tokens:
    key = hash(shared.value)
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = Tokens(shared.value)
    return _TOKENS[key]


def _shards(shared, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _tokens(shared)
        task, number = TaskContext.get().partitionId(), 0
        docs, counts, parts, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = write_shard(docs, counts, np.concatenate(parts), kind)
            row = [pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["task", "number", "data"])

        for part in (part for batch in batches for part in slices(batch, 1, BATCH_BYTES)):
            ids, borders = tokens.encode(part.column(1))
            ids = np.insert(ids, borders[1:], end_id)
            borders = borders + np.arange(len(borders))
            for doc, s, e in zip(part.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                docs.append(doc)
                counts.append(e - s)
                parts.append(ids[s:e])
                held += e - s
                if held >= SHARD_IDS:
                    yield shard()
                    docs, counts, parts, held, number = [], [], [], 0, number + 1
        if docs:
            yield shard()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, kind: str = "bit") -> None:
    """Writes the ids of every text, each followed by end_id, in ascending order of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:  # a vocabulary of a few MB, read on the driver
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    shards = map_arrow(ordered, _shards(shared, end_id, kind), "task int, number int, data binary")
    named = shards.select(F.format_string("%06d-%06d", "task", "number").alias("shard"), F.expr("cast(data as string)").alias("value"))
    named.write.option("maxRecordsPerFile", 1).partitionBy("shard").text(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            name = path.rpartition("shard=")[2].partition("/")[0]
            rows, at = [], 0
            for doc, ids in read_shard(data):
                rows.append((name, doc, at, len(ids), zlib.crc32(ids.tobytes())))
                at += len(ids)
            frame = pd.DataFrame(rows, columns=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the shards under path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInPandas(_documents, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    found = found.persist()
    before = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard, of about two million ids each
    base = before.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    path = path or scratch(docs.sparkSession, "planes")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, path)
