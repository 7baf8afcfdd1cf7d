"""Exact-size samples, stratified splits and folds as narrow filters on a row hash.

The cut-off hash of each class is found by counting hash prefixes (see ranks.hash_cuts); after that, which part a row
belongs to is a comparison inside the row. No class is ever gathered or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.functions.hashing import draw
from sievestone.operators.quantiles import quantiles
from sievestone.operators.ranks import hash_cut, hash_cuts

MIN_CLASS_SAMPLE = 5


def sample_rows(df: DataFrame, row_id: str, count: int, seed: int = 0) -> DataFrame:
    """Exactly `count` rows (or all)."""
    hashed = draw(seed, named(row_id))
    return df.filter(hashed <= hash_cut(df, hashed, count))


def class_sizes(df: DataFrame, target: str) -> dict:
    return {row["g"]: row["count"] for row in df.groupBy(named(target).cast("string").alias("g")).count().collect()}


def _class_cuts(df: DataFrame, row_id: str, target: str, wanted: dict, seed) -> dict:
    hashed = df.select(named(target).cast("string").alias("grp"), draw(seed, named(row_id)).alias("h"))
    return hash_cuts(hashed, wanted)


def _bucket(target: str, row_id: str, cuts: dict, seed) -> Column:
    """How many of its class's cuts a row lies beyond."""
    hashed = draw(seed, named(row_id))
    result = None
    for group, values in cuts.items():
        same = named(target).isNull() if group is None else named(target).cast("string") == group
        beyond = sum([F.when(hashed > F.lit(v), 1).otherwise(0) for v in values], F.lit(0))
        result = F.when(same, beyond) if result is None else result.when(same, beyond)
    return result


def stratified_sample(df: DataFrame, row_id: str, target: str | None, count: int, seed: int = 0) -> DataFrame:
    """About `count` rows, each class keeping its share but at least five rows where it has them."""
    if target is None:
        return sample_rows(df, row_id, count, seed)
    sizes = class_sizes(df, target)
    total = sum(sizes.values())
    wanted = {g: [min(n, max(MIN_CLASS_SAMPLE, int(round(n * count / total))))] for g, n in sizes.items()}
    cuts = _class_cuts(df, row_id, target, wanted, seed)
    return df.filter(_bucket(target, row_id, cuts, seed) == 0)


def split(df: DataFrame, row_id: str, target: str | None, shares: list[float], seed: int = 0) -> DataFrame:
    """Adds `part`: 0, 1, ... with the given shares, exactly within each class (cumulative counts rounded down)."""
    edges = [sum(shares[: i + 1]) for i in range(len(shares) - 1)]
    if target is None:
        n = df.count()
        hashed = df.select(F.lit("all").alias("grp"), draw(seed, named(row_id)).alias("h"))
        cuts = hash_cuts(hashed, {"all": [int(n * e + 1e-9) for e in edges]})["all"]
        mine = draw(seed, named(row_id))
        return df.withColumn("part", sum([F.when(mine > F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0)))
    wanted = {g: [int(n * e + 1e-9) for e in edges] for g, n in class_sizes(df, target).items()}
    cuts = _class_cuts(df, row_id, target, wanted, seed)
    return df.withColumn("part", _bucket(target, row_id, cuts, seed))


def folds(df: DataFrame, row_id: str, target: str | None, k: int, seed: int = 0) -> DataFrame:
    """Adds `fold` 0 .. k-1, equal within each class."""
    return split(df, row_id, target, [1.0 / k] * k, seed).withColumnRenamed("part", "fold")


def quantile_strata(df: DataFrame, column: str, bins: int = 5) -> Column:
    """Bin of a numeric target by exact quantile edges (repeated edges dropped), as text."""
    edges = quantiles(df, {column: (named(column), [i / bins for i in range(bins + 1)])})[column]
    position = F.lit(0)
    for edge in sorted(set(edges))[1:-1]:
        position = position + F.when(named(column) > F.lit(edge), 1).otherwise(0)
    return position.cast("string")
