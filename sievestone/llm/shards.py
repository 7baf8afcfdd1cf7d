"""Shards of bounded size by extendible hashing, with DataFrame functions only.

A row's place is a 60-bit hash of its key. The directory is indexed by the leading bits; a bucket over the byte limit is split
on its next bit, all others stay whole. Bytes are added up per prefix first, so rows are never gathered: splitting works on a
table of prefixes, and rows look their shard up by an equality join on the prefix.

Edge cases: null text has 0 bytes; null keys and equal keys share a hash, so rows of one key stay together; a bucket that 60
bits can't split (one key, or one row over the limit) stays whole with `fits` false. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.session import cut_lineage

HASH_BITS = 60


def place(key) -> F.Column:
    """The first 60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(bits, depth):
    return F.shiftright(bits, HASH_BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", bits, F.lit(HASH_BITS) - depth)


def directory(sized: DataFrame, limit: int, slack: int = 6) -> DataFrame:
    """(depth, prefix, shard_rows, shard_bytes, fits) of rows (bits, n_bytes): the leaves of the split tree."""
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    base, leaves = 0, []
    step = max(4, (total // limit + 1).bit_length() + slack)
    # nodes of the tree at depth `base` that are still to be judged, with the rows below them
    rest = sized
    while True:
        depth = min(HASH_BITS, base + step)
        fine = rest.groupBy(_prefix("bits", depth).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = fine.select(F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"), "p", "b", "n")
        nodes = levels.groupBy("depth", _prefix_of("p", depth).alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        nodes = cut_lineage(nodes)
        over = nodes.filter(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        fit = nodes.filter(F.col("shard_bytes") <= limit).withColumn("above", F.shiftright("prefix", 1))
        # a leaf fits and its parent does not; the root has no parent
        leaves.append(fit.join(over, ["depth", "above"], "left_semi").select("depth", "prefix", "shard_rows", "shard_bytes", F.lit(True).alias("fits")))
        if base == 0:
            leaves.append(fit.filter("depth = 0").select("depth", "prefix", "shard_rows", "shard_bytes", F.lit(True).alias("fits")))
        open_ = nodes.filter((F.col("depth") == depth) & (F.col("shard_bytes") > limit))
        if depth == HASH_BITS or open_.isEmpty():
            leaves.append(open_.select("depth", "prefix", "shard_rows", "shard_bytes", F.lit(False).alias("fits")))
            return cut_lineage(reduce(DataFrame.unionByName, leaves))
        rest = rest.join(open_.select(F.col("prefix").alias("top")), _prefix("bits", depth) == F.col("top"), "left_semi")
        base, step = depth, 8


def _prefix_of(column: str, from_depth: int):
    return F.call_function("shiftright", F.col(column), F.lit(from_depth) - F.col("depth"))


def shard_rows(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with shard (its hash prefix as bits), depth, shard_rows, shard_bytes and fits, and the row's own n_bytes."""
    clash = [c for c in df.columns if c in ("bits", "n_bytes", "shard", "depth", "shard_rows", "shard_bytes", "fits", "prefix")]
    placed = df.drop(*clash).withColumn("bits", place(key)).withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    leaves = directory(placed.select("bits", "n_bytes"), limit)
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61 numbers
    if not depths:
        depths = [0]
    # the leaf above a row: one row for every depth in use, of which exactly one meets a leaf
    wide = [c for c in placed.columns if c not in ("bits", "n_bytes")]
    places = placed.select("bits").distinct().select("bits", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix("bits", d).alias("prefix")) for d in sorted(depths)])).alias("t"))
    found = places.select("bits", "t.depth", "t.prefix").join(leaves, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    found = found.select("bits", name.alias("shard"), "depth", "shard_rows", "shard_bytes", "fits")
    return placed.join(found, "bits").select(*wide, "n_bytes", "shard", "depth", "shard_rows", "shard_bytes", "fits")


def write_shards(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """One folder a shard under `path`, each written by one task."""
    sharded = shard_rows(df, limit, key, text).drop("n_bytes", "depth", "shard_rows", "shard_bytes", "fits")
    sharded.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
