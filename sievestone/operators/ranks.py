"""Global order without a global sort: exact-count picks, running totals and ranks that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievestone.session import cut_lineage

PREFIX_DIGITS = 3  # hex digits counted per step: at most 4,096 counts per group come back to the driver
COLLECT_HASHES = 100_000  # hashes left in all open blocks before they are read directly
GROUP_ROWS = 2_000_000  # rows one task orders at most when numbering rows in hash order
SLICE_ROWS = 500_000  # rows of a value range that one task orders
SMALL_ROWS = 200_000  # up to this many distinct values one task sorts them all


def hash_cuts(hashed: DataFrame, wanted: dict) -> dict:
    """The k-th smallest hash of each group, exactly, by counting hash prefixes.

    `hashed` holds `grp` and `h` (32 hex digits, unique within a group); `wanted` maps a group to the ks it needs
    (1-based). Picking "the first k rows in hash order" is then the narrow filter h <= cut: no sort, no shuffle of
    the rows. A step returns only prefix counts, as a sum of numbers that needs no sort either; the next step looks inside
    the one prefix that holds the cut, and reads its hashes as soon as few are left.
    """
    pending = {(group, k): ("", k) for group, ks in wanted.items() for k in ks if k > 0}
    cuts: dict = {}
    digits, left_in, known = PREFIX_DIGITS, {}, 0
    while pending:
        open_blocks = {(group, prefix) for (group, _), (prefix, _) in pending.items()}
        if known == 0:
            block = hashed
        else:
            if sum(left_in.values()) <= COLLECT_HASHES:
                digits = 32
            inside = F.lit(False)
            for group, prefix in open_blocks:
                same = F.col("grp").isNull() if group is None else F.col("grp") == F.lit(group)
                inside = inside | (same & F.col("h").startswith(prefix))
            block = hashed.filter(inside)
        counts = (
            block.groupBy("grp", F.substring("h", 1, digits).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        by_block: dict = {}
        for row in counts:
            by_block.setdefault((row["grp"], row["prefix"][:known]), []).append(row)
        still_open, left_in = {}, {}
        for (group, k), (prefix, left) in pending.items():
            rows = sorted(by_block.get((group, prefix), []), key=lambda row: row["prefix"])
            for row in rows:
                if left <= row["n"]:
                    if digits >= 32:
                        cuts[(group, k)] = row["prefix"]
                    else:
                        still_open[(group, k)] = (row["prefix"], left)
                        left_in[(group, row["prefix"])] = row["n"]
                    break
                left -= row["n"]
            else:
                cuts[(group, k)] = "g"  # fewer than k rows: above every hex digit, so all are picked
        pending = still_open
        known, digits = digits, digits + PREFIX_DIGITS
    return {group: [cuts.get((group, k), "") for k in ks] for group, ks in wanted.items()}


def hash_cut(df: DataFrame, hashed: Column, k: int) -> str:
    """The k-th smallest hash over all rows of `df`; '' when k is 0, so that h <= cut picks nothing."""
    if k <= 0:
        return ""
    return hash_cuts(df.select(F.lit("all").alias("grp"), hashed.alias("h")), {"all": [k]})["all"][0]


def in_ranges(df: DataFrame, order: str, rows: int) -> DataFrame:
    """`df` as a written table in ranges of `order`, numbered by `_slice`: at least two, and about SLICE_ROWS rows each."""
    return cut_lineage(df.repartitionByRange(max(2, -(-rows // SLICE_ROWS)), order).withColumn("_slice", F.spark_partition_id()))


def running_totals(df: DataFrame, order: str, totals: list[str], small_rows: int | None = None) -> DataFrame:
    """Adds `<name>_before`: the sum of `name` over all rows with a smaller `order` value (values are distinct).

    Inputs of more than `small_rows` rows are cut into value ranges; ranges are summed in one aggregation, and each task then only
    orders its own range. What comes before a range is a window over the ranges, one row each.
    """
    count = df.count()
    inside = W.partitionBy("_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if count <= (SMALL_ROWS if small_rows is None else small_rows):
        sliced = df.withColumn("_slice", F.lit(0))
        return sliced.select(*sliced.columns, *[F.coalesce(F.sum(name).over(inside), F.lit(0)).alias(f"{name}_before") for name in totals]).drop("_slice")
    sliced = in_ranges(df, order, count)
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sliced.groupBy("_slice").agg(*[F.sum(name).alias(f"_sum_{name}") for name in totals])
    starts = starts.select("_slice", *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in totals])
    joined = sliced.join(F.broadcast(starts), "_slice")  # one row per SLICE_ROWS rows
    return joined.select(*df.columns, *[(F.coalesce(F.sum(name).over(inside), F.lit(0)) + F.col(f"_start_{name}")).alias(f"{name}_before") for name in totals])


def value_ranks(df: DataFrame, column: Column) -> DataFrame:
    """One row per distinct value: value, n, below (rows with a smaller value), average rank, cumulative share."""
    distinct = df.select(column.alias("value")).filter("value is not null").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column)).first()[0]
    ranked = running_totals(distinct, "value", ["n"]).withColumnRenamed("n_before", "below")
    return ranked.select(
        "value", "n", "below",
        (F.col("below") + (F.col("n") + 1) / 2.0).alias("mean_rank"),
        ((F.col("below") + F.col("n")) / F.lit(float(total or 1))).alias("cumulative_share"),
    )


def attach_ranks(df: DataFrame, column: str, output: str) -> DataFrame:
    """Adds the average rank of `column` (nulls stay null); the lookup is unique per value and hot values are handled."""
    ranks = value_ranks(df, F.col(column)).select(F.col("value").alias(column), "n", F.col("mean_rank").alias(output))
    return lookup_join(df, ranks, [column])


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str = "n", how: str = "left") -> DataFrame:
    """Join rows to a one-row-per-key lookup when one key may hold a large share of the rows.

    `lookup` carries how many rows each key has. Keys with more than 1/2000 of all rows can number at most 2,000,
    so that part is broadcast with a proven bound; the rest is shuffled and no key is hot there. `weight` is dropped.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    if total <= SMALL_ROWS * 50:
        return rows.join(lookup.drop(weight), keys, how)
    is_hot = F.col(weight) > F.lit(total / 2000.0)
    hot, cold = F.broadcast(lookup.filter(is_hot).drop(weight)), lookup.filter(~is_hot).drop(weight)
    from_hot = rows.join(hot, keys, "inner")
    from_cold = rows.join(hot, keys, "left_anti").join(cold, keys, how)
    return from_hot.unionByName(from_cold)


def hash_ranks(df: DataFrame, hashed: str, output: str) -> DataFrame:
    """Adds the 1-based position of each row in hash order. Hash prefixes cut the rows into even groups; the group
    starts (at most 16**5 numbers) are broadcast and each task orders only its own groups."""
    for digits in (PREFIX_DIGITS, 5):
        prefixed = df.withColumn("_prefix", F.substring(hashed, 1, digits))
        counts = sorted((row["_prefix"], row["count"]) for row in prefixed.groupBy("_prefix").count().collect())
        if max((n for _, n in counts), default=0) <= GROUP_ROWS:
            break
    starts, so_far = [], 0
    for prefix, count in counts:
        starts.append((prefix, so_far))
        so_far += count
    lookup = F.broadcast(df.sparkSession.createDataFrame(starts, "_prefix string, _start long"))
    inside = W.partitionBy("_prefix").orderBy(hashed)
    return prefixed.join(lookup, "_prefix").withColumn(
        output, F.row_number().over(inside) + F.col("_start")).drop("_prefix", "_start")


def rotated(df: DataFrame, group: list[str], hashed: str, value: str, output: str) -> DataFrame:
    """Adds the `value` of the next row of the group in hash order, the last row taking the first's: a random one-cycle shuffle.

    Rows are ordered inside ranges of their hash (four leading hex digits, 65,536 ranges a group); the last row of a range
    takes the first of the next range, read from a table with one row a range. The join uses the ranges' own partitioning.
    """
    ranged = df.withColumn("_range", F.substring(hashed, 1, 4))
    keys = [*group, "_range"]
    boxed = F.struct(F.col(value).alias("v"))
    heads = ranged.groupBy(*keys).agg(F.min_by(boxed, F.col(hashed)).alias("_head"))
    order = W.partitionBy(*group).orderBy("_range")
    around = F.coalesce(F.lead("_head").over(order), F.first("_head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(*keys, around.alias("_around"))
    inside = ranged.withColumn("_next", F.lead(boxed).over(W.partitionBy(*keys).orderBy(hashed)))
    return inside.join(heads, keys).select(*df.columns, F.coalesce("_next", "_around")["v"].alias(output))
