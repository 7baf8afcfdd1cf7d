"""Blind detectors that need no model: missing cells, duplicate records, outliers, case variants.

Each detector gives a long table of flagged cells or rows and a one-row table of rates; both stay lazy. The flags of
a row are computed inside that row, so only duplicates need a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import any_of, cells, count_when, folded, named, record_key
from sievestone.operators.quantiles import quantiles

# Fixed thresholds: when a value is flagged, and when it is far enough out to be repaired.
FLAG_K, FLAG_TAILS = 1.5, (0.005, 0.995)
STRICT_K, STRICT_TAILS = 3.0, (0.001, 0.999)
Z_LIMIT = 3.0


@dataclass(frozen=True)
class Fence:
    """Outlier bounds of one column; `by_tails` when the quartiles coincide and the tails rule applies."""

    low: float
    high: float
    by_tails: bool

    def outside(self, value: Column) -> Column:
        return (value < F.lit(self.low)) | (value > F.lit(self.high))

    def clip(self, value: Column) -> Column:
        return F.greatest(F.lit(self.low), F.least(F.lit(self.high), value))


# --- missing -----------------------------------------------------------------------------------------------------
def missing_cells(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """One row per missing cell."""
    found = cells(columns, keep=lambda c: named(c).isNull())
    return df.select(named(row_id).alias("row_id"), F.explode(found).alias("c")).select("row_id", "c.column")


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rate per cell, missing cells, rows with any missing cell, rows."""
    misses = [F.when(named(c).isNull(), 1).otherwise(0) for c in columns]
    per_row = sum(misses[1:], misses[0])
    return df.agg(
        F.coalesce(F.sum(per_row), F.lit(0)).cast("long").alias("missing_cells"),
        count_when(per_row > 0).alias("rows_with_missing"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("rate", F.col("missing_cells") / (F.col("rows") * len(columns)))


def missing_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing, rate: one aggregation, unpivoted afterwards (one row in, one row per column out)."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[count_when(named(c).isNull()).alias(f"m{i}")
                                                     for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
                     for i, c in enumerate(columns)])
    return wide.select("rows", F.explode(rows).alias("r")).select(
        "r.column", "r.missing", (F.col("r.missing") / F.col("rows")).alias("rate"))


# --- duplicates --------------------------------------------------------------------------------------------------
def first_copies(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Per distinct record: its first row and how many copies there are. Copies of one record combine before the
    shuffle, so a record that fills a third of the table is still a handful of rows on the wire."""
    keyed = df.select(named(row_id).alias("row_id"), *record_key(columns))
    return keyed.groupBy("record_1", "record_2").agg(F.min("row_id").alias("first_row"),
                                                     F.count(F.lit(1)).alias("copies"))


def duplicate_rows(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id of every row that repeats an earlier record (the first copy is kept).

    The anti join is on the unique row id, so it has no hot key however many copies a record has.
    """
    firsts = first_copies(df, row_id, columns).select(F.col("first_row").alias("row_id"))
    return df.select(named(row_id).alias("row_id")).join(firsts, "row_id", "left_anti")


def duplicates_with_first(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id of each duplicate with the row it copies."""
    from sievestone.operators.ranks import lookup_join

    repeated = first_copies(df, row_id, columns).filter("copies > 1")
    keyed = df.select(named(row_id).alias("row_id"), *record_key(columns))
    matched = lookup_join(keyed, repeated, ["record_1", "record_2"], weight="copies", how="inner")
    return matched.filter("row_id <> first_row").select("row_id", "first_row")


def duplicate_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat an earlier record, as a count and a share; needs record counts only."""
    groups = df.select(*record_key(columns)).groupBy("record_1", "record_2").agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                      F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("rows")).withColumn(
        "rate", F.col("duplicate_rows") / F.col("rows"))


# --- outliers ----------------------------------------------------------------------------------------------------
def fences(df: DataFrame, columns: list[str], rules=((FLAG_K, FLAG_TAILS),), in_task_rows=None) -> list[dict[str, Fence]]:
    """Outlier bounds per column, one dict per (k, tails) rule, all from one quantile pass."""
    probabilities = [0.25, 0.75] + [p for _, tails in rules for p in tails]
    found = quantiles(df, {c: (named(c), probabilities) for c in columns}, in_task_rows)
    result = []
    for number, (k, _) in enumerate(rules):
        bounds = {}
        for c in columns:
            q1, q3 = found[c][0], found[c][1]
            if q1 is None:
                continue
            spread = q3 - q1
            tails = found[c][2 + 2 * number: 4 + 2 * number]
            bounds[c] = Fence(*tails, True) if spread == 0 else Fence(q1 - k * spread, q3 + k * spread, False)
        result.append(bounds)
    return result


def outlier_cells(df: DataFrame, row_id: str, bounds: dict[str, Fence]) -> DataFrame:
    """One row per flagged cell with its value."""
    found = cells(bounds, value=lambda c: named(c).cast("double"), keep=lambda c: bounds[c].outside(named(c)))
    return df.select(named(row_id).alias("row_id"), F.explode(found).alias("c")).select("row_id", "c.*")


def outlier_rates(df: DataFrame, bounds: dict[str, Fence]) -> DataFrame:
    flagged = any_of(bounds[c].outside(named(c)) for c in bounds)
    cell_count = sum([count_when(bounds[c].outside(named(c))) for c in bounds], F.lit(0))
    return df.agg(count_when(flagged).alias("outlier_rows"), cell_count.cast("long").alias("outlier_cells"),
                  F.count(F.lit(1)).alias("rows")).withColumn("rate", F.col("outlier_rows") / F.col("rows"))


def outliers_by_column(df: DataFrame, bounds: dict[str, Fence]) -> DataFrame:
    names = list(bounds)
    wide = df.agg(*[count_when(bounds[c].outside(named(c))).alias(f"n{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(bounds[c].low).alias("low"),
                              F.lit(bounds[c].high).alias("high"), F.lit(bounds[c].by_tails).alias("by_tails"),
                              F.col(f"n{i}").alias("flagged_cells")) for i, c in enumerate(names)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def zscore_rates(df: DataFrame, columns: list[str], limit: float = Z_LIMIT) -> DataFrame:
    """Cells beyond `limit` population standard deviations, per column, plus the rows they sit in (column '*')."""
    moments = df.agg(*[f(named(c)).alias(f"{label}{i}") for i, c in enumerate(columns)
                       for label, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    tests = []
    for i, c in enumerate(columns):
        spread = moments[f"s{i}"]
        tests.append(F.abs((named(c) - F.lit(moments[f"m{i}"])) / F.lit(spread)) > limit if spread else F.lit(False))
    wide = df.agg(count_when(any_of(tests)).alias("rows_flagged"),
                  *[count_when(t).alias(f"n{i}") for i, t in enumerate(tests)])
    rows = F.array(F.struct(F.lit("*").alias("column"), F.col("rows_flagged").alias("flagged")),
                   *[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("flagged")) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def compare_outlier_rules(df: DataFrame, truth: DataFrame, row_id: str, column: str) -> DataFrame:
    """z-score, quartile and tails rules for one column, graded against the truly wrong rows side by side."""
    found = quantiles(df, {column: (named(column), [0.25, 0.75, 0.01, 0.99])})[column]
    moments = df.agg(F.avg(named(column)).alias("m"), F.stddev_samp(named(column)).alias("s")).first()
    value, spread = named(column), found[1] - found[0]
    rules = {
        "z-score": F.abs(value - F.lit(moments["m"])) / F.lit(moments["s"]) > Z_LIMIT,
        "quartiles": Fence(found[0] - FLAG_K * spread, found[1] + FLAG_K * spread, False).outside(value),
        "percentiles": Fence(found[2], found[3], True).outside(value),
    }
    marked = df.select(named(row_id).alias("row_id"), value.alias(column)).join(
        truth.select("row_id").distinct().withColumn("wrong", F.lit(True)), "row_id", "left")
    wrong = F.coalesce(F.col("wrong"), F.lit(False))
    wide = marked.agg(*[count_when(test & condition).alias(f"{name}:{part}") for name, test in rules.items()
                        for part, condition in (("hit", wrong), ("false", ~wrong))], count_when(wrong).alias("wrong"))
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), named(f"{name}:hit").alias("hits"),
                              named(f"{name}:false").alias("false_alarms"), F.col("wrong").alias("wrong_rows"))
                     for name in rules])
    return wide.select(F.explode(rows).alias("r")).select("r.*").select(
        "*", F.round(F.when(F.col("hits") + F.col("false_alarms") > 0,
                            F.col("hits") / (F.col("hits") + F.col("false_alarms"))), 6).alias("precision"),
        F.round(F.when(F.col("wrong_rows") > 0, F.col("hits") / F.col("wrong_rows")), 6).alias("recall"))


# --- case variants -----------------------------------------------------------------------------------------------
def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for every distinct non-missing value; the hot values combine before the shuffle."""
    return (df.select(F.explode(cells(columns)).alias("c")).select("c.*").filter("value is not null")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def case_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, spellings for values that differ from another one only in case or outer blanks."""
    counted = value_counts(df, columns).withColumn("key", folded(F.col("value")))
    several = counted.groupBy("column", "key").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("total"))
    several = several.filter("spellings > 1").drop("total")
    return counted.join(several, ["column", "key"]).select("column", "value", "n", "spellings")


def case_variant_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold any case variant. The variant list joins by equality, one column at a time, and Spark picks a
    broadcast when it is small."""
    variants = case_variants(df, columns).select("column", "value")
    marked = df
    for i, c in enumerate(columns):
        hit = variants.filter(F.col("column") == c).select(F.col("value").alias(f"_v{i}"))
        marked = marked.join(hit, named(c).cast("string") == F.col(f"_v{i}"), "left")
    flagged = any_of(F.col(f"_v{i}").isNotNull() for i in range(len(columns)))
    return marked.agg(count_when(flagged).alias("variant_rows"), F.count(F.lit(1)).alias("rows")).withColumn(
        "rate", F.col("variant_rows") / F.col("rows"))
