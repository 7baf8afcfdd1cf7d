"""Profiles of a table: structure, per-column statistics, distributions, and the health snapshot.

Scalar statistics of all columns come from one wide aggregation; anything per distinct value is grouped by
(column, value) with map-side combining; quantiles and ranks use the distributed helpers.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievestone.functions.columns import any_of, cells, count_when, named, squeezed, strip
from sievestone.operators import detect
from sievestone.operators.prepare import (MAX_CLASSES, MODEL_MAX_LEVELS, Prepared, is_formatted_number, is_number, is_token,
                                          kind_of, prepare)
from sievestone.operators.quantiles import quantiles
from sievestone.operators.ranks import value_ranks

# Fixed limits of the health snapshot.
SKEW_LIMIT, SKEW_MIN_VALUES = 1.5, 8
ID_MIN_VALUES = 20
RARE_CLASS_ROWS = 20
TOP_VALUES = 3


def unpivot_row(wide: DataFrame, columns: list[str], fields: list[str], name: str = "column") -> DataFrame:
    """One aggregated row with columns `<field>:<i>` as one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias(name), *[named(f"{f}:{i}").alias(f) for f in fields]) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def sample_skew(n: Column, biased: Column) -> Column:
    """Bias-corrected skewness from the population one."""
    return F.when(n > 2, biased * F.sqrt(n * (n - 1.0)) / (n - 2.0))


# --- scalar statistics -------------------------------------------------------------------------------------------
def number_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, max, mean, median, std, skew (bias-corrected)."""
    middle = quantiles(df, {c: (named(c), [0.5]) for c in columns})
    parts = []
    for i, c in enumerate(columns):
        value = named(c).cast("double")
        parts += [F.count(value).alias(f"n:{i}"), F.min(value).alias(f"min:{i}"), F.max(value).alias(f"max:{i}"),
                  F.avg(value).alias(f"mean:{i}"), F.lit(middle[c][0]).alias(f"median:{i}"), F.stddev_samp(value).alias(f"std:{i}"),
                  sample_skew(F.count(value), F.skewness(value)).alias(f"skew:{i}")]
    return unpivot_row(df.agg(*parts), columns, ["n", "min", "max", "mean", "median", "std", "skew"])


def dispersion(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five-number summary, range, IQR, variance, deviation and coefficient of variation."""
    q = quantiles(df, {c: (named(c), [0.25, 0.5, 0.75]) for c in columns})
    parts = []
    for i, c in enumerate(columns):
        v = named(c).cast("double")
        parts += [F.min(v).alias(f"min:{i}"), F.lit(q[c][0]).alias(f"q1:{i}"), F.lit(q[c][1]).alias(f"median:{i}"),
                  F.lit(q[c][2]).alias(f"q3:{i}"), F.max(v).alias(f"max:{i}"), (F.max(v) - F.min(v)).alias(f"range:{i}"),
                  F.lit(q[c][2] - q[c][0]).alias(f"iqr:{i}"), F.var_samp(v).alias(f"variance:{i}"),
                  F.stddev_samp(v).alias(f"std:{i}"), (F.stddev_samp(v) / F.avg(v)).alias(f"cv:{i}")]
    return unpivot_row(df.agg(*parts), columns, ["min", "q1", "median", "q3", "max", "range", "iqr", "variance", "std", "cv"])


def describe_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    q = quantiles(df, {c: (named(c), [0.25, 0.5, 0.75]) for c in columns})
    parts = []
    for i, c in enumerate(columns):
        v = named(c).cast("double")
        parts += [F.count(v).alias(f"count:{i}"), F.avg(v).alias(f"mean:{i}"), F.stddev_samp(v).alias(f"std:{i}"),
                  F.min(v).alias(f"min:{i}"), *[F.lit(x).alias(f"{p}:{i}") for p, x in zip(("q25", "q50", "q75"), q[c])],
                  F.max(v).alias(f"max:{i}")]
    return unpivot_row(df.agg(*parts), columns, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def describe_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, unique, top (smallest on ties), freq."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
    return detect.value_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best["value"].alias("top"), F.max("n").alias("freq"))


def central_tendency(df: DataFrame, columns: list[str], trim: float = 0.1) -> DataFrame:
    """mean, median, mode (smallest on ties), trimmed mean, mean - median, skew. The trimmed mean cuts int(trim * n) values
    at each end; it is summed over value counts inside the cut, so nothing is sorted in one place."""
    base = number_stats(df, columns).select("column", "n", "mean", "median", "skew").withColumn("gap", F.col("mean") - F.col("median"))
    extra = None
    for c in columns:
        ranks = value_ranks(df, named(c).cast("double"))
        n = df.agg(F.count(named(c))).first()[0]
        cut = int(trim * n)
        inside = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), F.lit(n - cut)) - F.greatest(F.col("below"), F.lit(cut)))
        row = ranks.agg(F.min(F.struct((-F.col("n")).alias("r"), F.col("value").alias("v")))["v"].alias("mode"),
                        (F.sum(F.col("value") * inside) / F.sum(inside)).alias("trimmed_mean")).select(F.lit(c).alias("column"), "*")
        extra = row if extra is None else extra.unionByName(row)
    return base.join(extra, "column").drop("n")


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    both = named(value).isNotNull() & named(weight).isNotNull()
    return df.filter(both).agg((F.sum(named(value) * named(weight)) / F.sum(named(weight))).alias("weighted_mean"))


def spread_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values within one, two and three sample deviations of the mean."""
    m = df.agg(*[f(named(c)).alias(f"{label}{i}") for i, c in enumerate(columns)
                 for label, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    parts = []
    for i, c in enumerate(columns):
        z = F.abs(named(c) - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"])
        parts += [F.avg(F.when(z <= k, 1.0).when(z > k, 0.0)).alias(f"within_{k}:{i}") for k in (1, 2, 3)]
    return unpivot_row(df.agg(*parts), columns, ["within_1", "within_2", "within_3"])


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population skewness and excess kurtosis."""
    parts = [e for i, c in enumerate(columns) for e in (F.skewness(named(c)).alias(f"skewness:{i}"), F.kurtosis(named(c)).alias(f"kurtosis:{i}"))]
    return unpivot_row(df.agg(*parts), columns, ["skewness", "kurtosis"])


def box_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, fences, whiskers (extreme values inside the fences) and how many values lie beyond."""
    q = quantiles(df, {c: (named(c), [0.25, 0.5, 0.75]) for c in columns})
    parts = []
    for i, c in enumerate(columns):
        q1, q2, q3 = q[c]
        fence = detect.Fence(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), False)
        v = named(c).cast("double")
        inside = F.when(~fence.outside(v), v)
        parts += [F.lit(q1).alias(f"q1:{i}"), F.lit(q2).alias(f"median:{i}"), F.lit(q3).alias(f"q3:{i}"),
                  F.lit(fence.low).alias(f"low_fence:{i}"), F.lit(fence.high).alias(f"high_fence:{i}"),
                  F.min(inside).alias(f"low_whisker:{i}"), F.max(inside).alias(f"high_whisker:{i}"),
                  count_when(fence.outside(v)).alias(f"beyond:{i}")]
    return unpivot_row(df.agg(*parts), columns, ["q1", "median", "q3", "low_fence", "high_fence", "low_whisker", "high_whisker", "beyond"])


# --- distributions -----------------------------------------------------------------------------------------------
def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin, the top edge in the last bin."""
    if high == low:
        return F.when(value.isNotNull(), 0)
    return F.least(F.lit(bins - 1), F.floor((value - F.lit(low)) / F.lit((high - low) / bins))).cast("int")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    edge = df.agg(F.min(named(column)).alias("lo"), F.max(named(column)).alias("hi")).first()
    lo, hi = float(edge["lo"]), float(edge["hi"])
    return df.select(bin_index(named(column).cast("double"), lo, hi, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n")).withColumn("low", F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins))


def heat_map(df: DataFrame, x: str, y: str, value: str, x_bins: int, y_bins: int) -> DataFrame:
    """Counts and mean of `value` over a grid of equal-width bins."""
    e = df.agg(F.min(named(x)).alias("x0"), F.max(named(x)).alias("x1"), F.min(named(y)).alias("y0"), F.max(named(y)).alias("y1")).first()
    return df.groupBy(bin_index(named(x).cast("double"), float(e["x0"]), float(e["x1"]), x_bins).alias("x_bin"),
                      bin_index(named(y).cast("double"), float(e["y0"]), float(e["y1"]), y_bins).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(named(value)).alias("mean"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of rows at or below it."""
    return value_ranks(df, named(column)).select("value", "n", "cumulative_share")


def qq_pairs(df: DataFrame, column: str, points: int = 19) -> DataFrame:
    """Sample quantiles next to normal quantiles at evenly spaced probabilities (a fixed number of points)."""
    probabilities = [i / (points + 1) for i in range(1, points + 1)]
    values = quantiles(df, {column: (named(column), probabilities)})[column]
    rows = [(p, float(v), NormalDist().inv_cdf(p)) for p, v in zip(probabilities, values)]
    return df.sparkSession.createDataFrame(rows, "p double, sample_quantile double, normal_quantile double")


def attribute_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, top value and share, whole numbers only, binary, and dominated (> 90%) per column."""
    best = F.min(F.struct((-F.col("n")).alias("r"), F.col("value").alias("value")))
    numeric = {c for c in columns if kind_of(df.schema[c].dataType) == "number"}
    number = F.col("value").try_cast("double")
    base = detect.value_counts(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), best["value"].alias("top_value"), (F.max("n") / F.sum("n")).alias("top_share"),
        F.bool_and(number % 1 == 0).alias("whole"))
    return base.select("column", "distinct", "top_value", "top_share",
                       F.when(F.col("column").isin(sorted(numeric)) if numeric else F.lit(False), F.col("whole")).alias("whole_numbers"),
                       (F.col("distinct") == 2).alias("is_binary"), (F.col("top_share") > 0.9).alias("is_dominated"))


def top_values(df: DataFrame, columns: list[str], top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column with their share: a top-k report. Each column keeps its best in a bounded
    aggregate, so a column with very many values is never sorted in one task."""
    counted = detect.value_counts(df, columns).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))
    local = W.partitionBy("column", "part").orderBy(F.desc("n"), "value")
    total = counted.groupBy("column").agg(F.sum("n").alias("total"))
    few = counted.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= top).join(F.broadcast(total), "column")
    final = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return few.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= top).select(
        "column", "place", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def structure(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, null cells, '?' cells, untrimmed text cells and constant columns in one pass, duplicates in another."""
    texts = [c for c in columns if kind_of(df.schema[c].dataType) == "text"]
    nothing = F.lit(0).cast("long")
    parts = df.agg(
        F.count(F.lit(1)).alias("rows"), sum([count_when(named(c).isNull()) for c in columns], nothing).alias("null_cells"),
        sum([count_when(strip(named(c)) == "?") for c in texts], nothing).alias("question_cells"),
        sum([count_when(strip(named(c)) != named(c)) for c in texts], nothing).alias("untrimmed_cells"),
        sum([F.when(F.min(named(c)).eqNullSafe(F.max(named(c))), 1).otherwise(0) for c in columns], nothing).alias("constant_columns"))
    dup = detect.duplicate_rate(df, columns).select("duplicate_rows")
    return parts.join(F.broadcast(dup))  # one row each


def compare_versions(versions: dict[str, DataFrame], column: str, columns: list[str]) -> DataFrame:
    """Rows, missing cells, duplicates, and centre and spread (robust and not) of one column in several versions."""
    out = None
    for tag, frame in versions.items():
        q = quantiles(frame, {column: (named(column), [0.25, 0.5, 0.75])})[column]
        row = frame.agg(F.count(F.lit(1)).alias("rows"), sum([count_when(named(c).isNull()) for c in columns]).alias("missing_cells"),
                        F.avg(named(column)).alias("mean"), F.stddev_samp(named(column)).alias("std"), F.max(named(column)).alias("max"))
        row = row.join(F.broadcast(detect.duplicate_rate(frame, columns).select("duplicate_rows")))
        row = row.select(F.lit(tag).alias("version"), "*", F.lit(q[1]).alias("median"), F.lit(q[2] - q[0]).alias("iqr"))
        out = row if out is None else out.unionByName(row)
    return out


# --- health snapshot ---------------------------------------------------------------------------------------------
def column_profile(prepared: Prepared) -> DataFrame:
    """Per stored column: kind, distinct values, blank / placeholder / code cells, missing share, constant and
    identifier flags."""
    source, frame = prepared.source, prepared.frame
    columns = [c for c in source.columns if c != prepared.row_id]
    kinds = {c: kind_of(source.schema[c].dataType) for c in columns}
    blanks = source.agg(F.count(F.lit(1)).alias("rows"), *[count_when(named(c).isNull()).alias(f"blank:{i}") for i, c in enumerate(columns)],
                        *[(count_when(is_token(named(c))) if kinds[c] == "text" else F.lit(0).cast("long")).alias(f"placeholder:{i}")
                          for i, c in enumerate(columns)],
                        *[(F.bool_and(is_formatted_number(named(c)) | is_number(named(c)) | is_token(named(c)))
                           & F.bool_or(is_formatted_number(named(c))) if kinds[c] == "text" else F.lit(False)).alias(f"formatted:{i}")
                          for i, c in enumerate(columns)])
    rows = unpivot_row(blanks.select("*", *[F.col("rows").alias(f"rows:{i}") for i in range(len(columns))]), columns,
                       ["rows", "blank", "placeholder", "formatted"])
    analysed = prepared.numbers + prepared.texts
    distinct = (frame.select(F.explode(cells(analysed)).alias("c")).select("c.*").filter("value is not null")
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column")
                .agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("filled")))
    coded = {c: sum(f.count for f in found) for c, found in prepared.codes.items() if c != prepared.target}
    lookup = lambda values, default: F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("column")], F.lit(default)) if values else F.lit(default)
    joined = rows.join(distinct, "column", "left")
    stored = lookup({c: k for c, k in kinds.items()}, "text")
    kind = (F.when(stored == "boolean", "boolean").when(stored == "temporal", "datetime").when(stored == "number", "numeric")
            .when(F.col("column").isin(prepared.numeric_text) if prepared.numeric_text else F.lit(False), "numeric stored as text")
            .when(F.col("formatted"), "formatted number stored as text")
            .when(F.col("n_unique") <= MODEL_MAX_LEVELS, "categorical").otherwise("text / high-cardinality"))
    code_cells = lookup({c: int(n) for c, n in coded.items()}, 0).cast("long")
    whole_or_text = ~F.col("column").isin([c for c in prepared.numbers if c not in prepared.integer_like] or ["\0"])
    return joined.select(
        "column", kind.alias("kind"), F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), F.col("blank").alias("blank_cells"),
        F.col("placeholder").alias("placeholder_cells"), code_cells.alias("code_cells"),
        (F.col("blank") + F.col("placeholder") + code_cells).alias("missing"),
        ((F.col("blank") + F.col("placeholder") + code_cells) / F.col("rows")).alias("missing_pct"),
        (F.coalesce(F.col("n_unique"), F.lit(0)) == 1).alias("is_constant"),
        F.coalesce((F.col("filled") >= ID_MIN_VALUES) & (F.col("n_unique") == F.col("filled")) & whole_or_text, F.lit(False))
        .alias("possible_identifier"))


def skewed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with |skew| above the limit, at least eight values and more than two distinct ones."""
    parts = []
    for i, c in enumerate(columns):
        v = named(c).cast("double")
        parts += [F.count(v).alias(f"n:{i}"), sample_skew(F.count(v), F.skewness(v)).alias(f"skew:{i}"), F.min(v).alias(f"lo:{i}"),
                  F.max(v).alias(f"hi:{i}")]
    wide = df.agg(*parts)
    edges = wide.first()
    inner = df.agg(*[count_when((named(c) != edges[f"lo:{i}"]) & (named(c) != edges[f"hi:{i}"])).alias(f"inner:{i}")
                     if edges[f"lo:{i}"] is not None else F.lit(0).cast("long").alias(f"inner:{i}") for i, c in enumerate(columns)])
    long = unpivot_row(wide, columns, ["n", "skew"]).join(F.broadcast(unpivot_row(inner, columns, ["inner"])), "column")
    return long.filter((F.abs("skew") > SKEW_LIMIT) & (F.col("n") >= SKEW_MIN_VALUES) & (F.col("inner") > 0)).select("column", "skew")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells, missing cells, rows with any missing cell, entirely missing columns."""
    missing = [named(c).isNull() for c in columns]
    zero = F.lit(0).cast("long")
    return df.agg((F.count(F.lit(1)) * len(columns)).alias("total_cells"), sum([count_when(m) for m in missing], zero).alias("missing_cells"),
                  count_when(any_of(missing)).alias("rows_with_missing"),
                  sum([F.when(F.count(named(c)) == 0, 1).otherwise(0) for c in columns], zero).alias("columns_entirely_missing"))


def duplicate_block(df: DataFrame, texts: list[str], columns: list[str]) -> DataFrame:
    """Exact duplicates, and the extra rows that become duplicates after squeezing text. Every exact duplicate is also a
    near one, so the extra rows are the difference of two distinct counts: no row-level join."""
    near = df.select(*[(squeezed(named(c)) if c in texts else named(c)).alias(c) for c in columns])
    exact = detect.duplicate_rate(df, columns).select(F.col("duplicate_rows").alias("exact_rows"), "rows")
    loose = detect.duplicate_rate(near, columns).select(F.col("duplicate_rows").alias("near_rows"))
    return exact.join(F.broadcast(loose)).select("rows", "exact_rows", (F.col("near_rows") - F.col("exact_rows")).alias("near_extra_rows"))


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """One row per class: rows, share, imbalance ratio, rare flag, usable flag."""
    counted = df.filter(named(target).isNotNull()).groupBy(named(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counted.agg(F.sum("rows").alias("total"), F.max("rows").alias("top"), F.min("rows").alias("low"), F.count(F.lit(1)).alias("classes"))
    return counted.join(F.broadcast(totals)).select(
        "value", "rows", (F.col("rows") / F.col("total")).alias("share"), (F.col("top") / F.col("low")).alias("imbalance_ratio"),
        (F.col("rows") < RARE_CLASS_ROWS).alias("is_rare"), F.col("classes").between(2, MAX_CLASSES).alias("usable"))


def target_profile_regression(df: DataFrame, target: str) -> DataFrame:
    """Quartiles, mean, population deviation, skew and code count of a numeric target."""
    from sievestone.operators.prepare import CODES, CODE_MAX_SHARE, judge_codes

    value = F.when(is_number(named(target).cast("string")), named(target).cast("string").try_cast("double"))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(named(target)).alias("filled"), F.count(value).alias("numeric"),
                  count_when(value < 0).alias("negatives"), *[count_when(value == float(c)).alias(f"c{c}") for c in CODES]).first()
    found = judge_codes({c: seen[f"c{c}"] for c in CODES}, seen["numeric"], seen["negatives"], seen["rows"])
    codes = found.codes if found is not None and found.share <= CODE_MAX_SHARE else []
    clean = df.select((F.when(~value.isin([float(c) for c in codes]), value) if codes else value).alias("y"))
    q = quantiles(clean, {"y": (F.col("y"), [0.25, 0.5, 0.75])})["y"]
    return clean.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count("y")).alias("rows_without_target"),
        F.lit(seen["filled"] - seen["numeric"]).cast("long").alias("non_numeric_values"),
        F.lit(found.count if codes else 0).cast("long").alias("code_values"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"),
        F.min("y").alias("min"), F.lit(q[0]).alias("q25"), F.lit(q[1]).alias("median"), F.lit(q[2]).alias("q75"), F.max("y").alias("max"),
        sample_skew(F.count("y"), F.skewness("y")).alias("skew"))


def snapshot_rows(prepared: Prepared, spelling=None) -> DataFrame:
    """The health snapshot as section, item, metric, value rows."""
    from sievestone.operators.spelling import analyse_spelling, spelling_cells

    def long(df, section, item=None):
        fields = [c for c in df.columns if c != item]
        rows = F.array(*[F.struct(F.lit(c).alias("metric"), named(c).cast("string").alias("value")) for c in fields])
        return df.select(F.lit(section).alias("section"), (named(item) if item else F.lit("")).alias("item"),
                         F.explode(rows).alias("r")).select("section", "item", "r.*").filter("value is not null")

    source, frame = prepared.source, prepared.frame
    columns = prepared.numbers + prepared.texts
    profile = column_profile(prepared)
    parts = [
        long(source.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(source.columns) - 1)), "overview"),
        long(profile.groupBy("kind").agg(F.count(F.lit(1)).alias("columns")), "column types", "kind"),
        long(completeness(frame, columns), "completeness"), long(profile, "columns", "column"),
        long(duplicate_block(frame, prepared.texts, columns), "duplicates")]
    if prepared.numbers:
        parts.append(long(number_stats(frame, prepared.numbers), "columns", "column"))
        bounds = detect.fences(frame, prepared.numbers)[0]
        parts.append(long(detect.outlier_rates(frame, bounds), "outliers (iqr)"))
        parts.append(long(detect.outliers_by_column(frame, bounds).filter("flagged_cells > 0").select("column", "flagged_cells"), "outliers (iqr)", "column"))
        parts.append(long(detect.zscore_rates(frame, prepared.numbers), "outliers (zscore)", "column"))
        parts.append(long(skewed_columns(frame, prepared.numbers), "skew", "column"))
    if prepared.texts:
        spelling = spelling or analyse_spelling(frame, prepared.texts)
        rules = spelling_cells(frame, prepared.row_id, spelling).groupBy(F.col("rule").alias("item")).agg(F.count(F.lit(1)).alias("cells"))
        parts.append(long(rules, "inconsistent spellings", "item"))
    if prepared.notes:
        notes = source.sparkSession.createDataFrame([("notes", "", "note", n) for n in prepared.notes], "section string, item string, metric string, value string")
        parts.append(notes)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_snapshot(df: DataFrame, row_id: str) -> DataFrame:
    """Health report of a raw table, without a target."""
    return snapshot_rows(prepare(df, row_id))


# --- validity rules ----------------------------------------------------------------------------------------------
def validity_report(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None,
                    one_to_one: tuple[str, str] | None = None) -> DataFrame:
    """Violations per rule (a rule is a condition that marks a bad row) with a verdict; uniqueness and a one-to-one
    mapping are counted from groups."""
    names = list(rules)
    wide = df.agg(*[count_when(rules[r]).alias(f"violations:{i}") for i, r in enumerate(names)])
    out = unpivot_row(wide, names, ["violations"], name="rule")
    if unique:
        dup = detect.duplicate_rate(df, unique).select(F.lit("unique " + ", ".join(unique)).alias("rule"), F.col("duplicate_rows").alias("violations"))
        out = out.unionByName(dup)
    if one_to_one:
        a, b = one_to_one
        pairs = df.groupBy(named(a).alias("a"), named(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(many.select(F.lit(f"{a} has one {b}").alias("rule"), "violations"))
    return out.withColumn("verdict", F.when(F.col("violations") == 0, "pass").otherwise("REVIEW"))
