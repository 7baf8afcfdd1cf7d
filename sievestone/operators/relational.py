"""Joins, grouping and ordering as a data analyst uses them, with the checks that keep them honest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.functions.hashing import draw
from sievestone.operators.ranks import hash_cut, in_ranges, running_totals

BLOCK_ROWS = 100_000  # neighbouring axis rows one task smooths

def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str | None = None) -> DataFrame:
    """A join that refuses duplicate keys on the side that must be unique ('many_to_one', 'one_to_many', 'one_to_one')."""
    sides = {"many_to_one": [("right", right)], "one_to_many": [("left", left)], "one_to_one": [("left", left), ("right", right)]}
    for side, frame in sides.get(validate, []):
        if frame.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{validate}: the {side} side has duplicate keys")
    return left.join(right, keys, how)


def join_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join with `merge_side`: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left_only").otherwise("right_only")
    return a.join(b, keys, "full").withColumn("merge_side", side).drop("_l", "_r")


def join_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows each kind of join would give, from key counts alone: the joins themselves are not run."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    pairs = a.join(b, keys, "full").select(F.coalesce("_a", F.lit(0)).alias("a"), F.coalesce("_b", F.lit(0)).alias("b"))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return pairs.agg(total(F.col("a") * F.col("b")).alias("inner_rows"), total(F.col("a") * one("b")).alias("left_rows"),
                     total(F.col("b") * one("a")).alias("right_rows"),
                     total(F.when((F.col("a") == 0) | (F.col("b") == 0), F.col("a") + F.col("b")).otherwise(F.col("a") * F.col("b"))).alias("outer_rows"))


def group_deviation(df: DataFrame, group: str, value: str, output: str) -> DataFrame:
    """Value minus its group's mean. The means are aggregated first and joined back, so a group that holds a third of
    the rows is never gathered in one task."""
    from sievestone.operators.ranks import lookup_join

    means = df.groupBy(named(group).alias(group)).agg(F.count(F.lit(1)).alias("n"), F.avg(named(value)).alias("_mean"))
    return lookup_join(df, means, [group]).withColumn(output, named(value) - F.col("_mean")).drop("_mean")


def keep_large_groups(df: DataFrame, group: str, at_least: int) -> DataFrame:
    from sievestone.operators.ranks import lookup_join

    sizes = df.groupBy(named(group).alias(group)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return lookup_join(df, sizes, [group], how="inner")


def mean_with_error(df: DataFrame, group: str, value: str) -> DataFrame:
    v = named(value)
    return df.groupBy(named(group).alias(group)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                                     (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("standard_error"))


def crosstab_share(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Row-normalised contingency table in long form."""
    counted = df.groupBy(named(rows).alias(rows), named(columns).alias(columns)).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("row_share", F.col("n") / F.sum("n").over(W.partitionBy(rows)))


def moving_average(points: DataFrame, order: str, value: str, width: int = 5, at_least: int = 1, group: list[str] | None = None) -> DataFrame:
    """Centred moving average over an ordered axis (one row per axis value), null below `at_least` points. Without groups the rows are
    numbered along the axis and cut into blocks; the few rows at a block's edge also go to its neighbour."""
    half = width // 2
    smooth = lambda window: F.when(F.count(value).over(window) >= at_least, F.avg(value).over(window))
    if group:
        return points.withColumn("smoothed", smooth(W.partitionBy(*group).orderBy(order).rowsBetween(-half, half)))
    numbered = running_totals(points.withColumn("_one", F.lit(1)), order, ["_one"], small_rows=0).withColumnRenamed("_one_before", "_at")
    size = max(BLOCK_ROWS, 2 * width)
    own, inside = F.floor(F.col("_at") / size), F.pmod("_at", F.lit(size))
    blocks = F.array_compact(F.array(own, F.when(inside < half, own - 1), F.when(inside >= size - half, own + 1)))
    spread = numbered.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    window = W.partitionBy("_block").orderBy("_at").rowsBetween(-half, half)
    return spread.withColumn("smoothed", smooth(window)).filter("_block = _own").drop("_one", "_at", "_own", "_block")


def dense_axis(points: DataFrame, order: str, value: str, size: str, at_least: int) -> DataFrame:
    """A whole-number axis without holes; values of groups smaller than `at_least` are suppressed."""
    edge = points.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    axis = edge.select(F.explode(F.sequence("lo", "hi")).alias(order))
    shown = points.select(order, F.when(F.col(size) >= at_least, F.col(value)).alias(value), size)
    return axis.join(shown, order, "left")


def interpolate(points: DataFrame, order: str, value: str) -> DataFrame:
    """Missing axis values filled on the straight line between their known neighbours. The axis is cut into ranges; a range gets the last
    known point before it and the first one after it from a table with one row a range."""
    sliced = in_ranges(points, order, points.count())
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    edges = sliced.groupBy("_slice").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    earlier, later = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), W.orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    edges = edges.select("_slice", F.last("last", ignorenulls=True).over(earlier).alias("_before"), F.first("first", ignorenulls=True).over(later).alias("_after"))
    joined = sliced.join(F.broadcast(edges), "_slice")  # one row per range
    inside = W.partitionBy("_slice").orderBy(order)
    left = F.coalesce(F.last(known, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_before"))
    right = F.coalesce(F.first(known, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)), F.col("_after"))
    found = joined.withColumn("_left", left).withColumn("_right", right)
    left, right = F.col("_left"), F.col("_right")
    line = F.when(left["x"] == right["x"], left["y"]).otherwise(
        left["y"] + (right["y"] - left["y"]) * (F.col(order) - left["x"]) / (right["x"] - left["x"]))
    return found.select(*points.columns, F.coalesce(F.col(value), line).alias("filled"))


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, spread: Column, parts: int = 32) -> DataFrame:
    """The first k rows of each group: every task keeps its own k first, then the survivors are ranked."""
    local = W.partitionBy(group, "_part").orderBy(*order)
    final = W.partitionBy(group).orderBy(*order)
    few = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts))).withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k)
    return few.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= k).drop("_r", "_part")


def halves(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """Adds `half`: 'explore' for exactly half of the rows (rounded down), 'confirm' for the rest."""
    hashed = draw(seed, named(row_id))
    cut = hash_cut(df, hashed, df.count() // 2)
    return df.withColumn("half", F.when(hashed <= cut, "explore").otherwise("confirm"))


def tagged_stack(frames: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    """Rows of several tables one below the other; missing columns become null."""
    out = None
    for name, frame in frames.items():
        piece = frame.withColumn(tag, F.lit(name))
        out = piece if out is None else out.unionByName(piece, allowMissingColumns=True)
    return out
