"""Ranked lexical search with a K2-treap over the grid of terms and documents.

Documents are indexed in blocks. A block is a square grid, a row for each of its terms and a column for each document in order of doc_id;
a cell holds the impact of the term in the document. The grid is kept as a quadtree without its empty parts: every node knows which of
its four quadrants hold something and the greatest impact inside, written as the difference to its parent's and compressed.

A search goes down the rows of all terms of an item at once. A range of columns is bounded by the sum, over the terms, of weight times the
maximum of the quadtree cell where the term's row crosses the range. Ranges are halved best-first, the best ones of a step together,
until no range that is left can reach the item's worst kept document. Ties count, so the result equals scoring every document; each
block adds at most `top` rows an item, and these are ranked at the end.

Every document is indexed. Statistics (documents, terms, document frequencies) come from all blocks. Items are searched in blocks of bounded
size, so any number of items works.

Edge cases: null and empty texts hold no term and are never found; a null doc_id sorts first; repeated rows are documents of their own;
rows of one item_id are one item; an item without terms, or without any in the documents, has no result; empty tables give no rows;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievestone.llm.shared import map_arrow, scratch, slices, text_bytes, word_hashes

BLOCK_BYTES, BLOCK_FILES, ITEM_TERMS, STEP = 8 << 20, 8, 1 << 20, 64
#: Fixed by the score: impact scale, frequency weight, length weight.
SCALE, TF, LENGTH = 10**9, 1000, 8
NO_TERM = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
NULL_ID = -(1 << 63)
INDEX = "doc_ids binary, terms binary, frequency binary, levels array<int>, quadrants binary, maxima binary"


def terms(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every term: runs of digits, letters and all that isn't ASCII, A-Z lower-cased."""
    return word_hashes(data, borders, NO_TERM)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 0)):
        n = np.bincount(terms(*text_bytes(batch.column(0)))[1], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["texts", "terms"])


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    found = map_arrow(docs.select("text"), _lengths, "texts long, terms long").agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return int(found[0]), int(found[1])


# ---------------------------------------------------------------- the tree

def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a zero between each two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def grow(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(nodes by level from the root, quadrants of every inner node as four bits, greatest value of every node)."""
    place = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(place)
    place, best = place[order], values[order]
    nodes, quadrants, maxima = [len(place)], [], [best]
    for _ in range(height):
        above = place >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        quadrants.append(np.bitwise_or.reduceat(np.uint8(1) << (place & np.uint64(3)).astype(np.uint8), first))
        best = np.maximum.reduceat(best, first)
        place = above[first]
        maxima.append(best)
        nodes.append(len(place))
    return nodes[::-1], np.concatenate([*quadrants[::-1], np.zeros(0, np.uint8)]), np.concatenate(maxima[::-1])


class Treap:
    """A block read back: nodes of all levels are numbered from the root, level by level; -1 is no node."""

    def __init__(self, nodes: list[int], quadrants: np.ndarray, maxima: np.ndarray):
        self.height = len(nodes) - 1
        self.quadrants = np.concatenate([quadrants, np.zeros(nodes[-1] + 1, np.uint8)])  # leaves, and the node that is none
        inner = np.bitwise_count(quadrants).astype(np.int32)
        self.child = np.concatenate([1 + np.cumsum(inner) - inner, np.zeros(nodes[-1] + 1, np.int32)]).astype(np.int32)
        self.maxima = np.concatenate([maxima, np.zeros(1, np.int64)])

    def down(self, cells: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        known = self.quadrants[cells]
        below = self.child[cells] + np.bitwise_count(known & ((1 << quadrant) - 1).astype(np.uint8))
        return np.where(known >> quadrant & 1, below, -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, top: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the `top` columns by falling score, then rising column, among those that score `least` or more."""
        bound, first, depth = np.array([(weights * self.maxima[0]).sum()]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), np.int64)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            order = np.lexsort((first, -bound))
            now, later = order[:STEP], order[STEP:]
            shift = self.height - 1 - depth[now]
            row_bit = rows[None, :] >> shift[:, None] & 1
            halves = [self.down(cells[now], (2 * row_bit + b).astype(np.uint8)) for b in (0, 1)]
            below = np.concatenate(halves)
            start = np.concatenate([first[now], first[now] + (1 << shift)])
            level = np.concatenate([depth[now] + 1] * 2)
            bounds = self.maxima[below] @ weights
            done = (level == self.height) & (bounds >= least)
            if done.any():
                columns, scores = np.concatenate([columns, start[done]]), np.concatenate([scores, bounds[done]])
                rank = np.lexsort((columns, -scores))[:top]
                columns, scores = columns[rank], scores[rank]
                if len(scores) == top:
                    least = max(least, int(scores[-1]))
            open_ = np.flatnonzero(level < self.height)
            bound, first, depth, cells = (np.concatenate([a[later], b[open_]]) for a, b in ((bound, bounds), (first, start), (depth, level), (cells, below)))
            useful = bound >= least
            if len(scores) == top:
                useful &= (bound > scores[-1]) | (first < columns[-1])
            bound, first, depth, cells = bound[useful], first[useful], depth[useful], cells[useful]
        return columns, scores


def _pack(x: np.ndarray) -> bytes:
    """Bytes of numbers, plane by plane, so that high bytes compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _parents(nodes: list[int], quadrants: np.ndarray) -> np.ndarray:
    """The number of the parent of every node but the root."""
    return np.repeat(np.arange(len(quadrants)), np.bitwise_count(quadrants))


# ---------------------------------------------------------------- index

def _blocks(texts: int, total: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, size)):
            found, owner = terms(*text_bytes(batch.column(1)))
            if not len(found):
                continue
            doc_ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            n = np.bincount(owner, minlength=len(doc_ids))
            order = np.argsort(doc_ids, kind="stable")
            order = order[n[order] > 0]
            column = np.zeros(len(doc_ids), np.int64)
            column[order] = np.arange(len(order))
            known, row = np.unique(found, return_inverse=True)
            cell, tf = np.unique(row * len(order) + column[owner], return_counts=True)
            row, at = cell // len(order), cell % len(order)
            m = np.array([10 + 90 * x * texts // total for x in n[order].tolist()], np.int64)
            impact = SCALE * tf // (TF * tf + LENGTH * m[at])
            height = int(max(len(known), len(order), 2) - 1).bit_length()
            nodes, quadrants, maxima = grow(row, at, impact, height)
            less = maxima.copy()
            less[1:] = maxima[_parents(nodes, quadrants)] - maxima[1:]
            if len(quadrants) % 2:
                quadrants = np.append(quadrants, np.uint8(0))
            halves = quadrants[::2] | quadrants[1::2] << 4
            parts = [_pack(doc_ids[order].astype(np.int64)), known.tobytes(), _pack(np.bincount(row).astype(np.uint32)), _pack(halves), _pack(less.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([p], pa.binary()) for p in parts[:3]), pa.array([nodes], pa.list_(pa.int32())), *(pa.array([p], pa.binary()) for p in parts[3:])],
                names=["doc_ids", "terms", "frequency", "levels", "quadrants", "maxima"])

    return run


def build_index(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes the index of `docs` (doc_id, text) under `path`: blocks of about `block_bytes` of text (or one longer text), and the statistics."""
    texts, total = statistics(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    map_arrow(rows, _blocks(texts, total, block_bytes), INDEX).write.option("maxRecordsPerFile", BLOCK_FILES).parquet(f"{path}/blocks")
    docs.sparkSession.createDataFrame([(texts, total)], "texts long, terms long").write.parquet(f"{path}/statistics")


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, Treap]:
    nodes = list(row["levels"])
    halves = _unpack(row["quadrants"], np.uint8)
    quadrants = np.stack([halves & 15, halves >> 4], 1).reshape(-1)[:sum(nodes[:-1])]
    maxima = _unpack(row["maxima"], np.uint32).astype(np.int64)
    parents, at = _parents(nodes, quadrants), 1
    for n in nodes[1:]:
        maxima[at:at + n] = maxima[parents[at - 1:at + n - 1]] - maxima[at:at + n]
        at += n
    return _unpack(row["doc_ids"], np.int64), np.frombuffer(row["terms"], np.uint64), Treap(nodes, quadrants, maxima)


# ---------------------------------------------------------------- search

def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owner = terms(*text_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(found.view(np.int64))], names=["item_id", "term"])


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                known = np.frombuffer(batch.column(0)[i].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[at] == wanted
                n = _unpack(batch.column(1)[i].as_py(), np.uint32)[at[hit]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[hit].view(np.int64)), pa.array(n)], names=["term", "n"])

    return run


def _search(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best: dict[int, list[int]] = {}  # scores kept so far in this task: a later block must reach the worst of them
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, known, treap = _load({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                out: list[tuple] = []
                for number, (hashes, weights) in enumerate(items):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = known[at] == hashes
                    if not hit.any():
                        continue
                    kept = best.get(number, [])
                    columns, scores = treap.best(at[hit], weights[hit], top, kept[-1] if len(kept) == top else 1)
                    out += [(number, d, s) for d, s in zip(doc_ids[columns].tolist(), scores.tolist())]
                    best[number] = sorted(kept + scores.tolist(), reverse=True)[:top]
                found = list(zip(*out)) if out else [[], [], []]
                ids = pa.array([None if d == NULL_ID else d for d in found[1]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), ids, pa.array(found[2], pa.int64())], names=["item", "doc_id", "score"])

    return run


def search(index_path: str, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item (item_id, text) by falling score above 0, then rising doc_id."""
    spark = items.sparkSession
    blocks = spark.read.parquet(f"{index_path}/blocks")
    texts = spark.read.parquet(f"{index_path}/statistics").first()["texts"]
    own = map_arrow(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), _item_terms, "item_id long, term long").distinct()
    n_blocks = int(own.count() // (ITEM_TERMS // 2)) + 1  # items in blocks of about ITEM_TERMS terms, one after the other on the driver
    results = []
    for b in range(n_blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).toArrow()
        wanted = np.unique(rows.column("term").to_numpy().view(np.uint64))
        found = map_arrow(blocks.select("terms", "frequency"), _frequencies(spark.sparkContext.broadcast(wanted)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist()))
        by_item: dict = {}
        for item, term in zip(rows.column("item_id").to_pylist(), rows.column("term").to_pylist()):
            if term in df:
                by_item.setdefault(item, []).append((term, int(np.floor(1000 * np.log((2 * texts + 2) / (2 * df[term] + 1))))))
        ids = list(by_item)
        packed = [(np.array([t for t, _ in by_item[i]], np.int64).view(np.uint64), np.array([w for _, w in by_item[i]], np.int64)) for i in ids]
        found = map_arrow(blocks, _search(spark.sparkContext.broadcast(packed), top), "item int, doc_id long, score long")
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        results.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results)


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Indexes `docs` under `path` (a new folder of the shared one if not given) and searches all `items`."""
    path = path or scratch(docs.sparkSession, "treaps")
    build_index(docs, path, block_bytes)
    return search(path, items, top)
