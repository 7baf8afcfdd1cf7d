"""Tests of association, intervals, transforms and encodings, from aggregated counts and moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievestone.functions.columns import count_when, named
from sievestone.functions.hashing import draw, draw_unit
from sievestone.functions.normal import chi2_cdf, student_cdf, student_quantile
from sievestone.operators.quantiles import quantiles
from sievestone.operators.ranks import attach_ranks, running_totals


# --- association -------------------------------------------------------------------------------------------------
def _pairs(columns: list[str]):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Upper triangle of the correlation matrix as a, b, r. All pairs come from one aggregation; Spearman ranks the
    columns first (average ranks, complete rows)."""
    if method == "spearman":
        df = df.dropna(subset=columns).select(*[named(c) for c in columns])
        for i, c in enumerate(columns):
            df = attach_ranks(df, c, f"_rank{i}")
        values = {c: F.col(f"_rank{i}") for i, c in enumerate(columns)}
    else:
        values = {c: named(c).cast("double") for c in columns}
    pairs = _pairs(columns)
    wide = df.agg(*[F.corr(values[a], values[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population covariance, a, b, cov."""
    pairs = _pairs(columns)
    wide = df.agg(*[F.covar_pop(named(a).cast("double"), named(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("cov")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs of two columns, missing ones left out."""
    return df.filter(named(a).isNotNull() & named(b).isNotNull()).groupBy(named(a).alias("a"), named(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, degrees of freedom, n and Cramer's V. Empty cells contribute through the margins, so only the pairs that
    occur are joined: chi2 = n * (sum of o^2 / (row * column) - 1)."""
    pairs = contingency(df, a, b)
    rows = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    columns = pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    joined = pairs.join(rows, "a").join(columns, "b")
    part = joined.agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))).alias("s"),
                      F.sum("n").alias("n"))
    sizes = rows.agg(F.count(F.lit(1)).alias("r")).join(F.broadcast(columns.agg(F.count(F.lit(1)).alias("c"))))
    both = part.join(F.broadcast(sizes))
    chi2 = F.col("n") * (F.col("s") - 1)
    return both.select(chi2.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), "n",
                       F.sqrt(chi2 / (F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"))


def chi_square_p(df: DataFrame, a: str, b: str) -> float:
    row = chi_square(df, a, b).first()
    return 1 - chi2_cdf(row["chi2"], row["dof"])


def welch(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Welch's t, its degrees of freedom and Cohen's d of two groups."""
    side = lambda g: F.when(named(group) == F.lit(g), named(value).cast("double"))
    m = df.agg(F.avg(side(first)).alias("m1"), F.avg(side(second)).alias("m2"), F.var_samp(side(first)).alias("v1"),
               F.var_samp(side(second)).alias("v2"), F.count(side(first)).alias("n1"), F.count(side(second)).alias("n2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    gap = F.col("m1") - F.col("m2")
    dof = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return m.select("m1", "m2", "n1", "n2", (gap / F.sqrt(e1 + e2)).alias("t"), dof.alias("dof"),
                    (gap / F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("cohens_d"))


def welch_p(df: DataFrame, value: str, group: str, first, second) -> float:
    row = welch(df, value, group, first, second).first()
    return 2 * (1 - student_cdf(abs(row["t"]), row["dof"]))


def mean_interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Mean with its Student confidence interval."""
    n = df.agg(F.count(named(value))).first()[0]
    critical = student_quantile(1 - (1 - level) / 2, n - 1)
    mean, error = F.avg(named(value)), F.stddev_samp(named(value)) / F.sqrt(F.count(named(value)))
    return df.agg(mean.alias("mean"), (mean - F.lit(critical) * error).alias("low"), (mean + F.lit(critical) * error).alias("high"),
                  F.count(named(value)).alias("n"))


def level_tests(df: DataFrame, column: str, target: Column, critical: float = 0.05) -> DataFrame:
    """One-vs-rest chi-square per level against a yes/no target, with the Bonferroni verdict."""
    counted = df.filter(named(column).isNotNull()).groupBy(named(column).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), count_when(target).alias("hits"))
    totals = counted.agg(F.sum("n").alias("total"), F.sum("hits").alias("all_hits"), F.count(F.lit(1)).alias("levels"))
    n, a, total, hits = (F.col(c).cast("double") for c in ("n", "hits", "total", "all_hits"))
    cross = a * (total - hits - n + a) - (hits - a) * (n - a)
    chi2 = total * cross * cross / (hits * (total - hits) * n * (total - n))
    levels = counted.agg(F.count(F.lit(1))).first()[0]
    limit = _chi2_one(critical / max(levels, 1))
    return counted.join(F.broadcast(totals)).select(
        "level", "n", "hits", chi2.alias("chi2"), (chi2 > F.lit(_chi2_one(critical))).alias("significant"),
        (chi2 > F.lit(limit)).alias("significant_corrected"))


def _chi2_one(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - p / 2) ** 2


def replicate_means(df: DataFrame, row_id: str, value: str, sizes: list[int], replicates: int, seed: int = 0) -> DataFrame:
    """Means of repeated random samples: every row draws once per (size, replicate) and joins it with probability
    size / rows, so the samples are made in one pass without moving rows."""
    rows = df.count()
    frame = df.select(named(row_id).alias("row_id"), named(value).alias("v"))
    spread = frame.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    picked = spread.filter(draw_unit(draw(seed, F.col("row_id"), F.col("size"), F.col("replicate"))) < F.col("size") / F.lit(rows))
    means = picked.groupBy("size", "replicate").agg(F.avg("v").alias("m"))
    return means.groupBy("size").agg(F.avg("m").alias("mean_of_means"), F.stddev_samp("m").alias("observed_spread"),
                                     F.count(F.lit(1)).alias("samples"))


def biased_sample(df: DataFrame, value: str, condition: Column) -> DataFrame:
    """Mean over everyone next to the mean of the part that answers."""
    return df.agg(F.avg(named(value)).alias("population_mean"), F.avg(F.when(condition, named(value))).alias("biased_mean"),
                  count_when(condition).alias("biased_rows"))


# --- transforms --------------------------------------------------------------------------------------------------
def scale(df: DataFrame, column: str) -> DataFrame:
    """Adds min-max, z and robust versions of a column."""
    m = df.agg(F.min(named(column)).alias("lo"), F.max(named(column)).alias("hi"), F.avg(named(column)).alias("m"),
               F.stddev_pop(named(column)).alias("s")).first()
    q1, q2, q3 = quantiles(df, {column: (named(column), [0.25, 0.5, 0.75])})[column]
    v = named(column)
    return df.select("*", ((v - m["lo"]) / F.lit(m["hi"] - m["lo"])).alias(f"{column}_minmax"),
                     ((v - F.lit(m["m"])) / F.lit(m["s"])).alias(f"{column}_z"), ((v - F.lit(q2)) / F.lit(q3 - q1)).alias(f"{column}_robust"))


def yeo_johnson(value: Column, power: float) -> Column:
    up = F.log1p(value) if abs(power) < 1e-12 else (F.pow(value + 1, power) - 1) / power
    down = -F.log1p(-value) if abs(power - 2) < 1e-12 else -(F.pow(1 - value, 2 - power) - 1) / (2 - power)
    return F.when(value >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, rounds: int = 4, steps: int = 12) -> float:
    """Power with the highest likelihood by repeated grid search; each round is one aggregation over all candidates."""
    v = named(column).cast("double")
    log_part = F.sum(F.signum(v) * F.log1p(F.abs(v)))
    for _ in range(rounds):
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        row = df.agg(F.count(v).alias("n"), log_part.alias("j"), *[F.var_pop(yeo_johnson(v, g)).alias(f"g{i}") for i, g in enumerate(grid)]).first()
        scores = [(-row["n"] / 2 * math.log(row[f"g{i}"]) + (g - 1) * row["j"], g) for i, g in enumerate(grid) if row[f"g{i}"]]
        best = max(scores)[1]
        width = (high - low) / steps
        low, high = best - width, best + width
    return best


def skew_by_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skew of each column raw, under sqrt, log1p and its fitted Yeo-Johnson power."""
    from sievestone.operators.profile import sample_skew, unpivot_row

    parts = []
    for i, c in enumerate(columns):
        v = named(c).cast("double")
        forms = {"original": v, "sqrt": F.sqrt(v), "log1p": F.log1p(v), "yeo_johnson": yeo_johnson(v, fit_yeo_johnson(df, c))}
        parts += [sample_skew(F.count(e), F.skewness(e)).alias(f"{name}:{i}") for name, e in forms.items()]
    return unpivot_row(df.agg(*parts), columns, ["original", "sqrt", "log1p", "yeo_johnson"])


def equal_frequency_bins(df: DataFrame, column: str, bins: int) -> Column:
    """0-based bin by exact quantile edges; repeated edges are dropped, intervals are closed on the right."""
    edges = quantiles(df, {column: (named(column), [i / bins for i in range(bins + 1)])})[column]
    inner = sorted(set(edges))[1:-1]
    position = F.lit(0)
    for edge in inner:
        position = position + F.when(named(column) > F.lit(edge), 1).otherwise(0)
    return F.when(named(column).isNotNull(), position)


def equal_width_bins(df: DataFrame, column: str, bins: int) -> Column:
    from sievestone.operators.profile import bin_index

    e = df.agg(F.min(named(column)).alias("lo"), F.max(named(column)).alias("hi")).first()
    return bin_index(named(column).cast("double"), float(e["lo"]), float(e["hi"]), bins)


# --- encodings ---------------------------------------------------------------------------------------------------
def label_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: levels numbered in sorted order (a dictionary of levels, not rows)."""
    levels = df.filter(named(column).isNotNull()).groupBy(named(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    numbered = running_totals(levels.withColumn("_one", F.lit(1)), "value", ["_one"], small_rows=0)
    return numbered.select("value", "n", F.col("_one_before").cast("int").alias("code"))


def ordinal_code(column: str, order: list[str]) -> Column:
    """Position of the value in its true order, null when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), named(column)), F.lit(0)) - 1


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    return df.select("*", *[F.when(named(column) == v, 1).otherwise(0).alias(f"{column}={v}") for v in levels])


def frequency_encoding(train: DataFrame, rows: DataFrame, column: str, output: str) -> DataFrame:
    """Share of each level in `train`, 0 for levels it never saw."""
    from sievestone.operators.ranks import lookup_join

    total = train.filter(named(column).isNotNull()).count()
    counts = train.filter(named(column).isNotNull()).groupBy(named(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    lookup = counts.withColumn(output, F.col("n") / F.lit(float(total or 1)))
    return lookup_join(rows, lookup, [column]).withColumn(output, F.coalesce(output, F.lit(0.0)))


def target_encoding(train: DataFrame, rows: DataFrame, column: str, hit: Column, output: str, smooth: float = 20.0) -> DataFrame:
    """Rate of `hit` per level in `train`, pulled towards the overall rate for small levels; unseen levels get it."""
    from sievestone.operators.ranks import lookup_join

    overall = train.agg(F.avg(hit.cast("double"))).first()[0]
    counts = train.filter(named(column).isNotNull()).groupBy(named(column).alias(column)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit.cast("double")).alias("_hits"))
    lookup = counts.select(column, "n", ((F.col("_hits") + F.lit(smooth * overall)) / (F.col("n") + F.lit(smooth))).alias(output))
    return lookup_join(rows, lookup, [column]).withColumn(output, F.coalesce(output, F.lit(overall)))


def ordered_summary(df: DataFrame, column: str, order: list[str], at_least: str) -> DataFrame:
    """Lowest, highest and median level of an ordered category, and the share at or above one level."""
    code = ordinal_code(column, order)
    counts = df.groupBy(code.cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n")).filter("code is not null")
    levels = counts.withColumn("_g", F.lit(0)).withColumn("upto", F.sum("n").over(W.partitionBy("_g").orderBy("code"))).withColumn(
        "total", F.sum("n").over(W.partitionBy("_g")))
    names = F.array(*[F.lit(v) for v in order])
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("code")))
    return levels.agg(F.element_at(names, F.min("code") + 1).alias("lowest"), F.element_at(names, F.max("code") + 1).alias("highest"),
                      F.element_at(names, middle + 1).alias("median_level"),
                      (F.sum(F.when(F.col("code") >= order.index(at_least), F.col("n")).otherwise(0)) / F.sum("n")).alias("share_at_least"))


def chance_macro_f1(df: DataFrame, target: str) -> DataFrame:
    """Macro F1 of always guessing the largest class."""
    counts = df.filter(named(target).isNotNull()).groupBy(named(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    p = F.max("n") / F.sum("n")
    return counts.agg((2 * p / (1 + p) / F.count(F.lit(1))).alias("chance_macro_f1"))


def banded_robust_z(df: DataFrame, row_id: str, residual: str, by: str, bands: int = 5) -> DataFrame:
    """row_id, band, z: distance of the residual from the band's median in 1.4826 MAD units (deviation where the MAD is
    zero). Bands are quantile bands of `by`; the medians come from the distributed quantile helper, one column per band."""
    band = equal_frequency_bins(df, by, bands)
    framed = df.select(named(row_id).alias("row_id"), named(residual).alias("res"), band.alias("band"))
    of_band = lambda e: {k: (F.when(F.col("band") == k, e), [0.5]) for k in range(bands)}
    middle = {k: v[0] for k, v in quantiles(framed, of_band(F.col("res"))).items()}
    pick = lambda values: F.coalesce(*[F.when(F.col("band") == k, F.lit(v)) for k, v in values.items() if v is not None])
    framed = framed.withColumn("gap", F.abs(F.col("res") - pick(middle)))
    mads = {k: (v[0] * 1.4826 if v[0] is not None else None) for k, v in quantiles(framed, of_band(F.col("gap"))).items()}
    spread = framed.groupBy("band").agg(F.stddev_pop("res").alias("s")).collect()
    scale_of = {r["band"]: (mads.get(r["band"]) or r["s"] or 0.0) for r in spread if r["band"] is not None}
    unit = pick(scale_of)
    return framed.select("row_id", "band", F.when(unit > 0, F.col("gap") / unit).otherwise(0.0).alias("z"))
