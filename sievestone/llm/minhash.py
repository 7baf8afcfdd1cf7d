"""Near-duplicate documents by MinHash with tensored banding, confirmed on whole shingle sets.

Two small collections of short MinHash keys are computed per document; every pair (one key of each) is a table key, so
SIDE * SIDE tables cost only 2 * SIDE * WIDTH hash functions. Documents that meet in a table are candidates. Links are
confirmed by the exact similarity of the full sets.

A group of n copies never yields n * n pairs. Exact copies are one node. In each of ROUNDS rounds a node is compared with one other: the
smallest node of its buckets that is in another component yet; what is confirmed is contracted. What is left are pairs of different
components inside a bucket: each such bucket hands on only a spanning forest of its close components (by one-bit hashes), which joins
components to families; every pair of nodes of a family that still belongs to different components is then compared on full sets, in
blocks, and only links that join components are handed on. The largest component of a bucket or family is never compared with itself, so
a large group of near copies costs what its rows and the few others make, not its square.

Edge cases: null or empty text, or white space only: no shingles, linked with nothing. Null doc_id: the row comes back with
null component_id, kept true. Rows that repeat a doc_id are one document that links with all its texts link with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import components, map_arrow, map_pandas, mix, odd_numbers, shingle_hashes, slices, text_bytes, word_hashes, written
from sievestone.session import cut_lineage

SIDE, WIDTH, BITS = 10, 2, 128
#: At similarity 0.8 on average 115 of 128 one-bit hashes agree (deviation 3.4); at 0.3 about 83.
LEAST_BITS = 98
BUCKET_BLOCK, SET_BLOCK, SMALL_GROUP, ROUNDS = 4096, 256, 64, 2
BROADCAST_IDS = 2_000_000
SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, left array<long>, right array<long>, bits1 long, bits2 long"


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    value, owner, _ = shingle_hashes(*word_hashes(*text_bytes(batch.column(1))), size)
    borders = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    return [np.unique(value[s:e]) for s, e in zip(borders[:-1], borders[1:])]


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = odd_numbers(11, BITS)
        salt = odd_numbers(12, 2 * SIDE)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = _sets(batch, size)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
            first = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64)
            least = np.zeros((BITS, len(full)), np.uint64)
            step = max(1, len(full) // (len(flat) // 200_000 + 1))
            for at in range(0, len(full), step):  # pieces that stay in the processor's cache
                lo = first[at]
                hi = first[at + step] if at + step < len(full) else len(flat)
                for k in range(BITS):
                    least[k, at:at + step] = np.minimum.reduceat(flat[lo:hi] * by[k], first[at:at + step] - lo)
            least = mix(least)
            keys = np.zeros((batch.num_rows, 2 * SIDE), np.uint64)
            for j in range(2 * SIDE):
                key = np.full(len(full), j + 1, np.uint64)
                for k in range(WIDTH):
                    key = mix(key * salt[j] + least[j * WIDTH + k])
                keys[full, j] = key
            bits = np.zeros((batch.num_rows, 2), np.uint64)
            for k in range(BITS):
                bits[full, k // 64] |= (least[k] & np.uint64(1)) << np.uint64(k % 64)
            sums = np.zeros((batch.num_rows, 2), np.uint64)
            if len(full):
                sums[full, 0] = np.add.reduceat(mix(flat), first)
                sums[full, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x5DEECE66D)), first)
            long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, SIDE, dtype=np.int32)), long(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), long(sums[:, 0]), long(sums[:, 1]), lists(keys[:, :SIDE]), lists(keys[:, SIDE:]), long(bits[:, 0]), long(bits[:, 1])],
                names=["doc_id", "n_shingles", "d1", "d2", "left", "right", "bits1", "bits2"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = _sets(batch, size)
            borders = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))], names=["doc_id", "shingles"])

    return run


def _sets_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    if wanted.count() <= BROADCAST_IDS:  # 16 MB of ids at most; beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    return cut_lineage(map_arrow(texts.join(wanted, "doc_id", "left_semi"), _full_sets(size), "doc_id long, shingles array<long>"))


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. One-bit hashes and sizes rule out most others first."""
    side = lambda c: nodes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits1").alias(f"x_{c}"), F.col("bits2").alias(f"y_{c}"))
    agree = BITS - F.bit_count(F.col("x_a").bitwiseXOR(F.col("x_b"))) - F.bit_count(F.col("y_a").bitwiseXOR(F.col("y_b")))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter((agree >= LEAST_BITS) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    near = cut_lineage(near.select("a", "b"))
    sets = _sets_of(texts, near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size)
    full = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return full.filter(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b").distinct()


def _sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of a partition sorted by (key, part), cut so that no group is split, and the number of each row's group."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key, part = batch["key"].to_numpy(), batch["part"].to_numpy()
        number = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))])
        cut = int(np.searchsorted(number, number[-1]))
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut], number[:cut]
    if rest is not None:
        yield rest, np.zeros(len(rest), np.int64)


def _root(tree: np.ndarray, i: int) -> int:
    while tree[i] != i:
        i = tree[i]
    return i


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the close components of every bucket, as pairs of components. Rows of role 0 are compared with each other and
    with all, rows of role 1 with those of role 2, rows of role 2 never with each other."""
    for rows, group in _sorted_groups(batches):
        comp, role = rows["component"].to_numpy(), rows["role"].to_numpy()
        bits = [rows[c].to_numpy().view(np.uint64) for c in ("bits1", "bits2")]
        last, found = np.searchsorted(group, group, "right"), []
        order = np.lexsort((comp, group))
        first = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (comp[order][1:] != comp[order][:-1])])
        tree = np.empty(len(rows), np.int64)  # a row points to a row of its group and component
        tree[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            differ = np.bitwise_count(bits[0][i] ^ bits[0][j]).astype(int) + np.bitwise_count(bits[1][i] ^ bits[1][j])
            apart = (comp[i] != comp[j]) & ((role[i] == 0) | (role[i] != role[j]))
            i, j = (side[(differ <= BITS - LEAST_BITS) & apart] for side in (i, j))
            if len(i) > SMALL_GROUP:  # one pair of rows for each pair of components is enough
                _, one = np.unique(np.stack([comp[i], comp[j]]), axis=1, return_index=True)
                i, j = i[one], j[one]
            for x, y in zip(i, j):
                a, b = _root(tree, int(x)), _root(tree, int(y))
                if a != b:
                    tree[max(a, b)] = min(a, b)
                    found.append((comp[x], comp[y]))

        size = np.bincount(group, minlength=group[-1] + 1)[group]
        at, far = np.flatnonzero(size <= SMALL_GROUP), 0
        while len(at):  # row i with row i + far, for all small buckets at once
            far += 1
            at = at[at + far < last[at]]
            meet(at, at + far)
        for start in np.unique(group[size > SMALL_GROUP]):
            lo, hi = np.searchsorted(group, [start, start + 1])
            for i in lo + np.flatnonzero(role[lo:hi] < 2):
                others = np.arange(lo, hi)
                others = others[(others > i) | (role[lo:hi] == 2)]
                meet(np.full(len(others), i), others)
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _links(percent: int):
    """Links between different components of a family, on full sets; one link for each two components it joins."""

    def links(group: pd.DataFrame) -> list[tuple[int, int]]:
        rep, comp, role = (group[c].to_numpy().copy() for c in ("rep", "component", "role"))
        sets = group["shingles"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(list(sets)), return_inverse=True)
        ends = np.cumsum(sizes)
        starts, mark, found = ends - sizes, np.zeros(flat.max() + 1, np.int64), []
        for i in np.flatnonzero(role < 2):
            open_ = (comp != comp[i]) & ((role == 2) | ((role == 0) & (role[i] == 0))) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            open_[:i + 1] &= role[:i + 1] == 2
            if not open_.any():
                continue
            own = flat[starts[i]:ends[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            for j in np.flatnonzero(open_ & (100 * shared >= percent * (sizes + sizes[i] - shared))):
                if comp[j] != comp[i]:
                    found.append((rep[i], rep[j]))
                    comp[comp == comp[j]] = comp[i]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in _sorted_groups(batches):
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
            found = [x for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1 for x in links(rows.iloc[s:e])]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, rep, component, ...) of groups with several components, dealt to parts of a group. The rows outside the group's largest
    component are cut into blocks of about `size`; a block meets itself (role 0), every other block (role 1 with role 2), and every block of
    the largest component, whose rows have role 2 throughout: its first block joins the parts of role 0."""
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("n_largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    groups = groups.filter("parts > 1").select("key", "largest", F.ceil((F.col("n") - F.col("n_largest")) / size).cast("int").alias("na"), F.ceil(F.col("n_largest") / size).cast("int").alias("nl"))
    dealt = rows.join(groups, "key")
    hot = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("rep"), F.when(hot, F.col("nl")).otherwise(F.col("na"))).cast("int")
    width = F.col("na") + F.col("nl")
    part = lambda i, j: i * width + j
    struct = lambda p, role: F.struct(p.cast("long").alias("part"), F.lit(role).alias("role") if isinstance(role, int) else role.alias("role"))
    active = F.sequence(F.lit(0), F.col("na") - 1)
    of_hot = F.transform(active, lambda i: struct(F.when(own == 0, part(i, i)).otherwise(part(i, F.col("na") + own)), 2))
    with_active = F.transform(active, lambda j: struct(part(F.least(own, j), F.greatest(own, j)), F.when(own == j, 0).when(own < j, 1).otherwise(2)))
    with_hot = F.transform(F.filter(F.sequence(F.lit(0), F.col("nl") - 1), lambda k: k > 0), lambda k: struct(part(own, F.col("na") + k), 1))
    dealt = dealt.select(*rows.columns, F.explode(F.when(hot, of_hot).otherwise(F.concat(with_active, with_hot))).alias("o")).select(*rows.columns, "o.part", "o.role")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "rep")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut_lineage(map_arrow(texts, _signatures(shingle), SIGNATURE))
    own = ["d1", "d2", "n_shingles"]
    same = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = same.groupBy(*own).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("left", "right", "bits1", "bits2")])
    # every node becomes SIDE * SIDE rows: more, smaller tasks than the bytes of the nodes alone call for
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = cut_lineage(nodes.withColumnRenamed("n_shingles", "n").repartition(spread, "rep"))
    tables = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: F.xxhash64(x, y))))
    buckets = nodes.select(F.explode(tables).alias("key"), "rep")
    lowest = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(buckets.join(lowest, "key").select("key", "rep", "low"), "buckets")

    star = written(shared.filter("rep <> low").select("rep", "low").distinct(), "star")
    label = lambda found: nodes.select("rep", "bits1", "bits2").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    links, first = None, None
    for _ in range(ROUNDS):  # one edge a node, to the smallest node it may still be joined to
        open_ = star
        if first is not None:
            known = lambda c: label(first).select(F.col("rep").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: E731, B023
            open_ = star.join(known("rep"), "rep").join(known("low"), "low").filter("of_rep <> of_low")
        pairs = open_.groupBy(F.col("rep").alias("a")).agg(F.min("low").alias("b"))
        more = _confirm(pairs, nodes, texts, shingle, percent)
        links = cut_lineage(more if links is None else links.unionByName(more))
        first = components(links)

    seen = shared.select("key", "rep").join(label(first), "rep")
    mixed = seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    close = map_pandas(_blocks(written(seen.join(mixed, "key"), "mixed"), BUCKET_BLOCK), _forest, "a long, b long")
    family = components(close).select(F.col("node").alias("component"), F.col("component").alias("key"))
    family = cut_lineage(family.unionByName(family.select(F.col("key").alias("component"), "key")).distinct())
    member = cut_lineage(label(first).join(family, "component").select("key", "rep", "component"))
    sets = _sets_of(texts, member.select(F.col("rep").alias("doc_id")), shingle)
    dealt = _blocks(member, SET_BLOCK).join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition("key", "part").sortWithinPartitions("key", "part", "rep")
    more = map_pandas(dealt, _links(percent), "a long, b long")
    links = cut_lineage(links.unionByName(more))
    found = components(links)
    of_set = nodes.select("d1", "d2", F.col("n").alias("n_shingles"), "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        *own, F.coalesce("component", "rep").alias("component_id"))
    by_set = rows.select("doc_id", *own).join(of_set, own, "left").select("doc_id", "n_shingles", "component_id")
    linked = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return by_set.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
