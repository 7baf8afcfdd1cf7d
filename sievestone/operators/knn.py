"""Numeric imputation from like rows: one rule at every size, made of one aggregation and lookups in a bounded table.

Every number column is cut at its deciles (a missing value is a class of its own). A missing cell takes the mean of the
known cells of its column in the rows that agree with its row on the deciles of the DEPTH other columns most correlated with
that column. With fewer than NEIGHBOURS such rows the least correlated column is left out, then the next; with none left the
column's median is taken. The table of means has at most 11 + 11**2 + 11**3 rows a column, so it is broadcast whatever the
number of rows, and no row is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.operators.quantiles import quantiles

NEIGHBOURS = 5
DEPTH = 3
DECILES = [k / 10 for k in range(1, 10)]
CLASSES = len(DECILES) + 2
PAIRS_A_PASS = 200


def _partners(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Up to DEPTH other columns per column, the most correlated first; column order on ties."""
    strength: dict[tuple[str, str], float] = {}
    pairs = list(combinations(columns, 2))
    for at in range(0, len(pairs), PAIRS_A_PASS):
        part = pairs[at: at + PAIRS_A_PASS]
        row = df.agg(*[F.corr(named(a), named(b)).alias(f"r{i}") for i, (a, b) in enumerate(part)]).first()
        for i, pair in enumerate(part):
            r = row[f"r{i}"]
            strength[pair] = strength[pair[::-1]] = 0.0 if r is None or r != r else round(abs(r), 6)
    return {c: sorted((o for o in columns if o != c), key=lambda o: -strength[(c, o)])[:DEPTH] for c in columns}


def _decile(value: Column, cuts: list[float]) -> Column:
    """0 for a missing value, else 1 + the number of deciles below it."""
    return F.when(value.isNull(), 0).otherwise(sum(((value > F.lit(cut)).cast("int") for cut in cuts), F.lit(1)))


def like_row_cells(df: DataFrame, row_id: str, columns: list[str], fill: list[str] | None = None) -> DataFrame:
    """row_id, column, value for every missing cell of `fill` (default: all `columns`). A column without any value gives none."""
    fill = columns if fill is None else fill
    found = quantiles(df, {c: (named(c), [*DECILES, 0.5]) for c in columns})
    fill = [c for c in fill if found[c][-1] is not None]
    if not fill:
        return df.sparkSession.createDataFrame([], "row_id long, column string, value double")
    partners = _partners(df, columns)
    place = {c: i for i, c in enumerate(columns)}
    coded = df.select(named(row_id).cast("long").alias("row_id"), *[named(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)],
                      *[(_decile(named(c), found[c][:-1]) if found[c][-1] is not None else F.lit(0)).alias(f"d{i}") for i, c in enumerate(columns)])

    def key(column: str) -> Column:
        code = F.lit(0)
        for other in partners[column]:
            code = code * CLASSES + F.col(f"d{place[other]}")
        return code

    depth = {c: len(partners[c]) for c in fill}
    cells = F.array(*[F.when(F.col(f"v{place[c]}").isNotNull(), F.struct(F.lit(c).alias("column"), key(c).alias("key"), F.col(f"v{place[c]}").alias("v"))) for c in fill])
    finest = coded.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("c")).groupBy("c.column", "c.key").agg(F.count(F.lit(1)).alias("n"), F.sum("c.v").alias("s"))
    means = [finest.withColumn("key", F.floor(F.col("key") / CLASSES**left).cast("int")).groupBy("column", "key").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias(f"m{left}")).filter(F.col("n") >= NEIGHBOURS).drop("n") for left in range(DEPTH)]
    asks = F.array(*[F.when(F.col(f"v{place[c]}").isNull(), F.struct(F.lit(c).alias("column"), key(c).alias("key"), F.lit(found[c][-1]).alias("middle"),
                                                                     F.lit(depth[c]).alias("depth"))) for c in fill])
    out = coded.select("row_id", F.explode(F.filter(asks, lambda x: x.isNotNull())).alias("c")).select("row_id", "c.*")
    for left, table in enumerate(means):
        coarse = F.floor(F.col("key") / CLASSES**left).cast("int")
        out = out.withColumn("_key", F.when(F.col("depth") > left, coarse)).join(
            F.broadcast(table.withColumnsRenamed({"column": "_column", "key": "_of"})), (F.col("column") == F.col("_column")) & (F.col("_key") == F.col("_of")), "left").drop("_column", "_of", "_key")
    return out.select("row_id", "column", F.coalesce(*[F.col(f"m{left}") for left in range(DEPTH)], "middle").alias("value"))
