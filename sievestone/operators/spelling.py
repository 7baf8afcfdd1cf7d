"""One real value written several ways in one column: format variants, abbreviations, possible typos.

All rules work on the dictionary of distinct values, which the free-text guard bounds, and candidates are found by
equality on generated forms (prefixes, initials, one-deletion neighbours). No pair of values is compared unless they
share such a form.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.functions.columns import any_of, broadcast_checked, count_when, named

# Fixed limits of the rules.
FREE_TEXT_KEYS = 50
FREE_TEXT_SHARE = 0.5
SHORT_LETTERS = 3
SHORT_MAX_SHARE = 0.30
TYPO_MIN_LENGTH = 5
TYPO_MAX_SHARE = 0.05
CHAIN_STEPS = 4
SHOWN_OPTIONS = 4  # named in the text of a flag; their full number decides

# Decoration dropped at both ends of a value, and separators that count as one blank inside it.
DECORATION = " \t\r\n.,;:'\"`’"
INNER_SEPARATORS = re.compile(r"(?<=\w)[\s_\-.]+(?=\w)")
BLANKS = re.compile(r"\s+")


@F.pandas_udf(T.StringType())
def value_key(values: pd.Series) -> pd.Series:
    """Comparison form: accents and case removed, outer decoration dropped, inner separators made one blank. Symbols
    that carry meaning stay. Runs on distinct values only."""
    def one(value):
        if value is None:
            return None
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", value) if not unicodedata.combining(ch))
        return BLANKS.sub(" ", INNER_SEPARATORS.sub(" ", plain.casefold().strip(DECORATION)))

    return values.map(one)


def is_one_edit(a: Column, b: Column) -> Column:
    """Exactly one insert, delete, substitution or adjacent swap apart, with no digit involved."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), longer), lambda i: ~F.substr(a, i, F.lit(1)).eqNullSafe(F.substr(b, i, F.lit(1))))
    at = F.get(places, F.lit(0))
    a_at, b_at = F.substr(a, at, F.lit(1)), F.substr(b, at, F.lit(1))
    a_next, b_next = F.substr(a, at + 1, F.lit(1)), F.substr(b, at + 1, F.lit(1))
    digit = r"^\d$"
    same_length = F.length(a) == F.length(b)
    substituted = same_length & (F.size(places) == 1) & ~a_at.rlike(digit) & ~b_at.rlike(digit)
    swapped = (same_length & (F.size(places) == 2) & (F.get(places, F.lit(1)) == at + 1)
               & (a_at == b_next) & (a_next == b_at) & ~a_at.rlike(digit) & ~b_at.rlike(digit))
    long_text = F.when(F.length(a) > F.length(b), a).otherwise(b)
    short_text = F.when(F.length(a) > F.length(b), b).otherwise(a)
    extra = F.substr(long_text, at, F.lit(1))
    without = F.concat(F.substr(long_text, F.lit(1), at - 1), F.substr(long_text, at + 1, longer))
    inserted = (longer == shorter + 1) & (without == short_text) & ~extra.rlike(digit)
    return F.coalesce(substituted | swapped | inserted, F.lit(False))


@dataclass
class Spelling:
    """`flags`: one row per (column, raw value) that is not canonical; `skipped`: free-text columns."""

    flags: DataFrame
    analysed: list[str]
    skipped: dict[str, str]
    filled: dict[str, int]


def value_dictionary(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], dict[str, str], dict[str, int]]:
    """column, value, key, n of the columns that hold categories, after the free-text guard.

    Free text, whatever the size: more than FREE_TEXT_KEYS keys that also outnumber half of the filled cells. Both are counted
    exactly, on the distinct values.
    """
    from sievestone.operators.detect import value_counts
    from sievestone.session import cut_lineage

    if not columns:
        raise ValueError("no text columns")
    skipped: dict[str, str] = {}
    words = cut_lineage(value_counts(df, columns).withColumn("key", value_key("value")))
    sizes = {row["column"]: row for row in words.groupBy("column").agg(
        F.count(F.lit(1)).alias("raw"), F.count_distinct(F.xxhash64("key")).alias("keys"), F.sum("n").alias("filled")).collect()}
    filled = {c: sizes[c]["filled"] if c in sizes else 0 for c in columns}
    kept = [c for c in columns if c in sizes and sizes[c]["raw"] >= 2]
    for c in list(kept):
        keys = sizes[c]["keys"]
        if keys > FREE_TEXT_KEYS and keys > FREE_TEXT_SHARE * filled[c]:
            skipped[c] = f"free text: {keys} different values in {filled[c]} filled cells"
            kept.remove(c)
    return words.filter(F.col("column").isin(kept) & (F.col("key") != "")), kept, skipped, filled


def analyse_spelling(df: DataFrame, columns: list[str]) -> Spelling:
    """Find the non-canonical spellings of every category column."""
    from sievestone.session import cut_lineage

    words, analysed, skipped, filled = value_dictionary(df, columns)
    keys = words.groupBy("column", "key").agg(
        F.sum("n").alias("total"),
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))["value"].alias("canon"))

    variants = words.join(keys, ["column", "key"]).filter("value <> canon").select(
        "column", "value", F.col("canon").alias("proposed"), F.lit("format_variant").alias("rule"),
        F.lit("strict").alias("tier"),
        F.format_string("same value as '%s' apart from case, spacing, punctuation or accents", "canon").alias("detail"),
        F.lit(2).alias("precedence"))

    # Abbreviations: a short key that equals a prefix or the initials of exactly one longer key.
    shorts = keys.withColumn("flat", F.replace("key", F.lit(" "), F.lit(""))).filter(
        (F.length("flat") <= SHORT_LETTERS) & ~F.col("flat").rlike(r"^\d+$"))
    longest_prefix = 2 * SHORT_LETTERS - 1
    forms = F.transform(F.sequence(F.lit(1), F.lit(longest_prefix)),
                        lambda i: F.when(i < F.length("key"), F.substr(F.col("key"), F.lit(1), i)))
    parts = F.split("key", " ")
    initials = F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))
    by_prefix = keys.select("column", "key", "total", "canon", F.explode(forms).alias("form")).filter("form is not null")
    by_initials = keys.select("column", "key", "total", "canon", initials.alias("form")).filter("form is not null")
    short = shorts.select("column", F.col("key").alias("short"), "flat", F.col("total").alias("short_total"))
    long = lambda frame: frame.select("column", "form", F.col("key").alias("long"),
                                      F.col("total").alias("long_total"), F.col("canon").alias("long_canon"))
    candidates = (
        short.withColumn("form", F.col("short")).join(long(by_prefix), ["column", "form"])
        .unionByName(short.withColumn("form", F.col("flat")).join(long(by_initials), ["column", "form"]))
    ).filter((F.col("short") != F.col("long")) & (F.length("long") > F.length("short"))).drop("form", "flat").distinct()
    judged = candidates.groupBy("column", "short", "short_total").agg(
        F.count(F.lit(1)).alias("n_long"), F.max("long_total").alias("top_total"), F.min("long").alias("only_long"))
    shown = candidates.withColumn("_place", F.row_number().over(W.partitionBy("column", "short").orderBy("long"))).filter(
        F.col("_place") <= SHOWN_OPTIONS).groupBy("column", "short").agg(F.array_sort(F.collect_list(F.struct("long", "long_canon"))).alias("options"))
    minority = F.col("short_total") / (F.col("short_total") + F.col("top_total")) <= SHORT_MAX_SHARE
    merges = judged.filter((F.col("n_long") == 1) & (F.col("short_total") <= F.col("top_total")) & minority).select(
        "column", "short", F.col("only_long").alias("target"))
    merges = cut_lineage(merges)
    chained = merges
    for _ in range(CHAIN_STEPS - 1):  # a short key may itself abbreviate one that abbreviates another
        step = merges.select("column", F.col("short").alias("target"), F.col("target").alias("next"))
        chained = chained.join(step, ["column", "target"], "left").select(
            "column", "short", F.coalesce("next", "target").alias("target"))
    canon_of = keys.select("column", F.col("key").alias("target"), "canon")
    abbreviations = (chained.join(canon_of, ["column", "target"]).withColumnRenamed("short", "key")
                     .join(words.select("column", "key", "value"), ["column", "key"]).select(
        "column", "value", F.col("canon").alias("proposed"), F.lit("abbreviation").alias("rule"),
        F.lit("strict").alias("tier"),
        F.format_string("'%s' looks like an abbreviation of '%s' (the only value it could stand for)",
                        "value", "canon").alias("detail"), F.lit(1).alias("precedence")))
    ambiguous = (judged.filter((F.col("n_long") > 1) & minority).join(shown, ["column", "short"]).select(
        "column", F.col("short").alias("key"),
        F.array_join(F.transform("options", lambda o: F.concat(F.lit("'"), o["long_canon"], F.lit("'"))), ", ").alias("names"))
        .join(words.select("column", "key", "value"), ["column", "key"]).select(
        "column", "value", F.lit(None).cast("string").alias("proposed"), F.lit("ambiguous_abbreviation").alias("rule"),
        F.lit("loose").alias("tier"),
        F.format_string("could abbreviate more than one value (%s); not repaired", "names").alias("detail"),
        F.lit(3).alias("precedence")))

    # Possible typos: keys that share a one-deletion form, then the exact one-edit test.
    open_keys = (keys.join(merges.select("column", F.col("short").alias("key")), ["column", "key"], "left_anti")
                 .filter(F.length("key") >= TYPO_MIN_LENGTH))
    deletions = F.transform(F.sequence(F.lit(0), F.length("key")), lambda i: F.when(i == 0, F.col("key")).otherwise(
        F.concat(F.substr(F.col("key"), F.lit(1), i - 1), F.substr(F.col("key"), i + 1, F.length("key")))))
    spread = open_keys.select("column", "key", "total", "canon", F.explode(F.array_distinct(deletions)).alias("form"))
    other = spread.select("column", "form", F.col("key").alias("near"), F.col("total").alias("near_total"),
                          F.col("canon").alias("near_canon"))
    pairs = spread.join(other, ["column", "form"]).filter("key <> near").drop("form", "canon").distinct()
    single = pairs.filter(is_one_edit(F.col("key"), F.col("near"))).groupBy("column", "key", "total").agg(
        F.count(F.lit(1)).alias("hits"), F.min("near_total").alias("near_total"), F.min("near_canon").alias("near_canon"))
    typos = (single.filter((F.col("hits") == 1) & (F.col("total") <= TYPO_MAX_SHARE * F.col("near_total")))
             .join(words.select("column", "key", "value"), ["column", "key"]).select(
        "column", "value", F.lit(None).cast("string").alias("proposed"), F.lit("possible_typo").alias("rule"),
        F.lit("loose").alias("tier"),
        F.format_string("possible typo of '%s' (flagged, not repaired)", "near_canon").alias("detail"),
        F.lit(4).alias("precedence")))

    # One rule per raw value: an abbreviation beats a format variant, and flags never replace a proposal.
    first = W.partitionBy("column", "value").orderBy("precedence")
    chosen = (abbreviations.unionByName(variants).unionByName(ambiguous).unionByName(typos)
              .withColumn("_order", F.row_number().over(first)).filter("_order = 1"))
    filled_map = F.create_map(*[F.lit(x) for pair in filled.items() for x in pair])
    flags = chosen.join(words.select("column", "value", "n"), ["column", "value"]).select(
        "column", "value", "proposed", "rule", "tier", "detail",
        (F.col("n") / filled_map[F.col("column")]).alias("share"), "n")
    return Spelling(cut_lineage(flags), analysed, skipped, filled)


def spelling_cells(df: DataFrame, row_id: str, spelling: Spelling) -> DataFrame:
    """One row per flagged cell. The size of the flag list is checked before it is broadcast."""
    if not spelling.analysed:
        return df.sparkSession.createDataFrame([], (
            "row_id long, column string, original_value string, proposed_value string, rule string, tier string, "
            "detail string, share double"))
    long = df.select(named(row_id).alias("row_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), named(c).alias("value")) for c in spelling.analysed])).alias("c")).select(
        "row_id", "c.column", "c.value")
    return long.join(broadcast_checked(spelling.flags.drop("n")), ["column", "value"]).select(
        "row_id", "column", F.col("value").alias("original_value"), F.col("proposed").alias("proposed_value"),
        "rule", "tier", "detail", "share")


def spelling_rate(df: DataFrame, row_id: str, spelling: Spelling) -> DataFrame:
    """Rows holding a flagged cell. One broadcast lookup per column keeps the count inside the row: no shuffle."""
    marked, hits = df, []
    for i, c in enumerate(spelling.analysed):
        bad = spelling.flags.filter(F.col("column") == c).select(F.col("value").alias(f"_bad{i}"))
        marked = marked.join(broadcast_checked(bad), named(c) == F.col(f"_bad{i}"), "left")
        hits.append(F.col(f"_bad{i}").isNotNull())
    return marked.agg(count_when(any_of(hits)).alias("flagged_rows"), F.count(F.lit(1)).alias("rows")).withColumn(
        "rate", F.col("flagged_rows") / F.col("rows"))
