"""Registered queries: profiles and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog import sqltext as q
from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import MESSY_SQL, SALES_COLUMNS, SALES_NUMBERS, SALES_SQL, SALES_TEXTS, messy, read, sales
from sievestone.operators import inject, profile
from sievestone.operators.prepare import prepare

QUERIES, SQL, query = registry()
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(columns, template, source):
    return " UNION ALL ".join(template.replace("{c}", c) + f" FROM {source}" for c in columns)


@query("number_stats", each(LINE, """SELECT '{c}' AS "column", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean,
 round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skew""", "lineitem"))
def _(spark, sf):
    return rounded(profile.number_stats(read(spark, sf, "lineitem"), LINE), 4, ["mean", "median", "std", "skew"])


@query("column_profile", f"""WITH {MESSY_SQL}, t AS (SELECT 'segment' AS "column", 'categorical' AS kind, count(DISTINCT CASE WHEN NOT ({q.is_token('segment')}) THEN segment END) AS n_unique,
  count(*) FILTER (WHERE {q.is_token('segment')}) AS placeholder_cells, 0 AS code_cells, count(*) AS rows FROM messy UNION ALL
 SELECT 'balance', 'numeric', count(DISTINCT CASE WHEN balance <> -999 THEN balance END), 0, count(*) FILTER (WHERE balance = -999), count(*) FROM messy UNION ALL
 SELECT 'comma_price', 'numeric stored as text', count(DISTINCT CASE WHEN comma_price <> '-' THEN comma_price END), count(*) FILTER (WHERE comma_price = '-'), 0, count(*) FROM messy UNION ALL
 SELECT 'word', 'categorical', count(DISTINCT word) - 1, 0, count(*) FILTER (WHERE word LIKE 'Unknown%'), count(*) FROM messy UNION ALL
 SELECT 'zip', CASE WHEN count(DISTINCT zip) <= 50 THEN 'categorical' ELSE 'text / high-cardinality' END, count(DISTINCT zip), 0, 0, count(*) FROM messy)
 SELECT "column", kind, n_unique, placeholder_cells, code_cells, placeholder_cells + code_cells AS missing,
  round((placeholder_cells + code_cells) / rows::DOUBLE, 6) AS missing_pct, false AS is_constant,
  "column" = 'zip' AND n_unique = rows AS possible_identifier FROM t""")
def _(spark, sf):
    frame = messy(spark, sf).select("row_id", "segment", "balance", "comma_price", "word", "zip")
    return rounded(profile.column_profile(prepare(frame, "row_id")).drop("blank_cells"), 6)


@query("top_values", " UNION ALL ".join(f"""SELECT '{c}' AS "column", place, value, n, round(n / total::DOUBLE, 6) AS share FROM (SELECT {c} AS value, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, {c}) AS place, sum(count(*)) OVER () AS total FROM orders GROUP BY 1) WHERE place <= 3""" for c in ("o_orderstatus", "o_orderpriority")))
def _(spark, sf):
    return rounded(profile.top_values(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), 6)


SKEWED = "SELECT o_totalprice AS price, o_totalprice * o_totalprice * o_totalprice * o_totalprice * o_totalprice AS fifth, (o_orderkey % 100 = 0)::INT::DOUBLE AS flag FROM orders"


@query("skewed_columns", f"""WITH t AS ({SKEWED}), s AS (SELECT 'price' AS "column", skewness(price) AS skew, count(DISTINCT price) AS d FROM t UNION ALL
 SELECT 'fifth', skewness(fifth), count(DISTINCT fifth) FROM t UNION ALL SELECT 'flag', skewness(flag), count(DISTINCT flag) FROM t)
 SELECT "column", round(skew, 4) AS skew FROM s WHERE abs(skew) > 1.5 AND d > 2""")
def _(spark, sf):
    p = F.col("o_totalprice")
    frame = read(spark, sf, "orders").select(p.alias("price"), (p * p * p * p * p).alias("fifth"),
                                             (F.col("o_orderkey") % 100 == 0).cast("int").cast("double").alias("flag"))
    return rounded(profile.skewed_columns(frame, ["price", "fifth", "flag"]), 4)


DIRTY = f"WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', SALES_COLUMNS, SALES_COLUMNS, 0.05, 7)} "
NULLS = " + ".join(f"({c} IS NULL)::INT" for c in SALES_COLUMNS)


@query("completeness", DIRTY + f"""SELECT count(*) * 6 AS total_cells, sum({NULLS})::BIGINT AS missing_cells, count(*) FILTER (WHERE {NULLS} > 0) AS rows_with_missing,
 ({' + '.join(f'(count({c}) = 0)::INT' for c in SALES_COLUMNS)})::BIGINT AS columns_entirely_missing FROM dirty""")
def _(spark, sf):
    dirty = inject.inject_missing(sales(spark, sf), "row_id", SALES_COLUMNS, 0.05, 7).frame
    return profile.completeness(dirty, SALES_COLUMNS)


@query("exact_and_near_duplicates", """WITH t AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '  ' || upper(lang) || ' ' ELSE lang END AS lang, source, n_chars % 50 AS size FROM documents)
 SELECT count(*) AS rows, count(*) - count(DISTINCT (lang, source, size)) AS exact_rows,
 count(DISTINCT (lang, source, size)) - count(DISTINCT (lower(trim(lang)), lower(trim(source)), size)) AS near_extra_rows FROM t""")
def _(spark, sf):
    frame = read(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  "), F.upper("lang"), F.lit(" "))).otherwise(F.col("lang")).alias("lang"),
        "source", (F.col("n_chars") % 50).alias("size"))
    return profile.duplicate_block(frame, ["lang", "source"], ["lang", "source", "size"])


@query("target_profile", """WITH c AS (SELECT CAST(quality AS VARCHAR) AS value, count(*) AS rows FROM labels GROUP BY 1)
 SELECT value, rows, round(rows / sum(rows) OVER ()::DOUBLE, 6) AS share, round(max(rows) OVER () / min(rows) OVER ()::DOUBLE, 6) AS imbalance_ratio,
 rows < 20 AS is_rare, count(*) OVER () BETWEEN 2 AND 20 AS usable FROM c""")
def _(spark, sf):
    return rounded(profile.target_profile(read(spark, sf, "labels"), "quality"), 6)


@query("regression_target_profile", """WITH t AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN -999.0 ELSE o_totalprice END AS y FROM orders), v AS (SELECT y FROM t WHERE y <> -999)
 SELECT (SELECT count(*) FROM t) AS rows, (SELECT count(*) FROM t WHERE y = -999) AS rows_without_target, 0::BIGINT AS non_numeric_values,
 (SELECT count(*) FROM t WHERE y = -999) AS code_values, round(avg(y), 2) AS mean, round(stddev_pop(y), 2) AS std, min(y) AS min, round(quantile_cont(y, 0.25), 2) AS q25,
 round(quantile_cont(y, 0.5), 2) AS median, round(quantile_cont(y, 0.75), 2) AS q75, max(y) AS max, round(skewness(y), 4) AS skew FROM v""")
def _(spark, sf):
    frame = read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 40 == 0, F.lit(-999.0)).otherwise(F.col("o_totalprice")).alias("y"))
    out = profile.target_profile_regression(frame, "y")
    return rounded(rounded(out, 2, ["mean", "std", "q25", "median", "q75"]), 4, ["skew"])


@query("health_snapshot")
def _(spark, sf):
    return profile.build_snapshot(messy(spark, sf), "row_id")


@query("structural_inspection", f"""WITH {MESSY_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE segment IS NULL) + count(*) FILTER (WHERE text_price IS NULL) + count(*) FILTER (WHERE nation IS NULL) AS null_cells,
 count(*) FILTER (WHERE trim(segment) = '?') + count(*) FILTER (WHERE trim(text_price) = '?') AS question_cells,
 count(*) FILTER (WHERE trim(segment) <> segment) + count(*) FILTER (WHERE trim(text_price) <> text_price) AS untrimmed_cells, 0::BIGINT AS constant_columns,
 count(*) - count(DISTINCT (segment, text_price, nation)) AS duplicate_rows FROM messy""")
def _(spark, sf):
    return profile.structure(messy(spark, sf), ["segment", "text_price", "nation"])


@query("describe_numbers", each(LINE, """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
 round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max""", "lineitem"))
def _(spark, sf):
    return rounded(profile.describe_numbers(read(spark, sf, "lineitem"), LINE), 4)


@query("describe_texts", each(["p_brand", "p_type"], """SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS unique,
 (SELECT {c} FROM part GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS top, (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY {c})) AS freq""", "part"))
def _(spark, sf):
    return profile.describe_texts(read(spark, sf, "part"), ["p_brand", "p_type"])


@query("attribute_types", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS distinct, (SELECT CAST({c} AS VARCHAR) FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top_value,
 round(max(n) / sum(n)::DOUBLE, 6) AS top_share, {whole} AS whole_numbers, count(*) = 2 AS is_binary, max(n) / sum(n)::DOUBLE > 0.9 AS is_dominated FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1)"""
    for c, whole in (("l_linenumber", "bool_and(l_linenumber % 1 = 0)"), ("l_returnflag", "NULL::BOOLEAN"), ("l_linestatus", "NULL::BOOLEAN"), ("l_discount", "bool_and(l_discount % 1 = 0)"))))
def _(spark, sf):
    return rounded(profile.attribute_types(read(spark, sf, "lineitem"), ["l_linenumber", "l_returnflag", "l_linestatus", "l_discount"]), 6)


@query("central_tendency", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(skewness(v), 4) AS skew,
 round(avg(v) - quantile_cont(v, 0.5), 4) AS gap, (SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
 round((SELECT avg({c}) FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM lineitem) WHERE rn > floor(0.1 * n) AND rn <= n - floor(0.1 * n)), 4) AS trimmed_mean
 FROM (SELECT {c} AS v FROM lineitem)""" for c in ("l_quantity", "l_discount")))
def _(spark, sf):
    return rounded(profile.central_tendency(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), 4)


@query("weighted_mean", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM lineitem")
def _(spark, sf):
    return rounded(profile.weighted_mean(read(spark, sf, "lineitem"), "l_discount", "l_quantity"), 6)


@query("dispersion", each(LINE, """SELECT '{c}' AS "column", min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3,
 max({c}) AS max, round(max({c}) - min({c}), 4) AS range, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(var_samp({c}), 2) AS variance,
 round(stddev_samp({c}), 4) AS std, round(stddev_samp({c}) / avg({c}), 4) AS cv""", "lineitem"))
def _(spark, sf):
    out = profile.dispersion(read(spark, sf, "lineitem"), LINE)
    return rounded(rounded(out, 2, ["variance"]), 4, ["q1", "median", "q3", "range", "iqr", "std", "cv"])


@query("spread_shares", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg((abs({c} - m) / s <= 1)::INT), 6) AS within_1, round(avg((abs({c} - m) / s <= 2)::INT), 6) AS within_2,
 round(avg((abs({c} - m) / s <= 3)::INT), 6) AS within_3 FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)""" for c in ("l_quantity", "l_extendedprice")))
def _(spark, sf):
    return rounded(profile.spread_shares(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), 6)


@query("histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
 SELECT least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))::INT AS bin, count(*) AS n, round(any_value(lo) + least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20))) * any_value((hi - lo) / 20), 4) AS low
 FROM lineitem, e GROUP BY least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))""")
def _(spark, sf):
    return rounded(profile.histogram(read(spark, sf, "lineitem"), "l_extendedprice", 20), 4)


@query("box_summary", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events),
 f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
 SELECT 'value' AS "column", round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, round(any_value(lo), 4) AS low_fence, round(any_value(hi), 4) AS high_fence,
 min(value) FILTER (WHERE value >= lo AND value <= hi) AS low_whisker, max(value) FILTER (WHERE value >= lo AND value <= hi) AS high_whisker, count(*) FILTER (WHERE value < lo OR value > hi) AS beyond FROM events, f""")
def _(spark, sf):
    return rounded(profile.box_summary(read(spark, sf, "events"), ["value"]), 4, ["q1", "median", "q3", "low_fence", "high_fence"])


@query("ecdf", """SELECT value, n, round(sum(n) OVER (ORDER BY value) / sum(n) OVER ()::DOUBLE, 6) AS cumulative_share FROM (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    return rounded(profile.ecdf(read(spark, sf, "lineitem"), "l_quantity"), 6, ["cumulative_share"])


@query("heat_map", """WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem)
 SELECT least(4, floor((l_quantity - x0) / ((x1 - x0) / 5)))::INT AS x_bin, least(2, floor((l_discount - y0) / ((y1 - y0) / 3)))::INT AS y_bin, count(*) AS n,
 round(avg(l_extendedprice), 2) AS mean FROM lineitem, e GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(profile.heat_map(read(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 5, 3), 2)


@query("qq_pairs", " UNION ALL ".join(f"SELECT {i / 20} ::DOUBLE AS p, round(quantile_cont(o_totalprice, {i / 20}), 2) AS sample_quantile FROM orders" for i in range(1, 20)))
def _(spark, sf):
    return rounded(profile.qq_pairs(read(spark, sf, "orders"), "o_totalprice").select("p", "sample_quantile"), 2, ["sample_quantile"])


@query("distribution_shape", each(LINE[:2], """SELECT '{c}' AS "column", round(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)), 4) AS skewness,
 round(kurtosis_pop({c}), 4) AS kurtosis""", "lineitem"))
def _(spark, sf):
    return rounded(profile.shape(read(spark, sf, "lineitem"), LINE[:2]), 4)


@query("before_after_comparison", f"""WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', SALES_COLUMNS, SALES_COLUMNS, 0.05, 7)},
 filled AS (SELECT row_id, status, price, priority, segment, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM dirty)) AS balance, nation FROM dirty) """ + " UNION ALL ".join(
    f"""SELECT '{t}' AS version, count(*) AS rows, sum({NULLS})::BIGINT AS missing_cells, round(avg(balance), 2) AS mean, round(stddev_samp(balance), 2) AS std, max(balance) AS max,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(SALES_COLUMNS)} FROM {t})) AS duplicate_rows, round(quantile_cont(balance, 0.5), 2) AS median, round(quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25), 2) AS iqr FROM {t}"""
    for t in ("sales", "dirty", "filled")))
def _(spark, sf):
    clean = sales(spark, sf)
    dirty = inject.inject_missing(clean, "row_id", SALES_COLUMNS, 0.05, 7).frame
    middle = profile.quantiles(dirty, {"b": (F.col("balance"), [0.5])})["b"][0]
    filled = dirty.withColumn("balance", F.coalesce("balance", F.lit(middle)))
    out = profile.compare_versions({"sales": clean, "dirty": dirty, "filled": filled}, "balance", SALES_COLUMNS)
    return rounded(out, 2, ["mean", "std", "median", "iqr"])


@query("validity_rules", """SELECT 'price is given' AS rule, count(*) FILTER (WHERE o_totalprice IS NULL) AS violations, 'pass' AS verdict FROM orders
 UNION ALL SELECT 'price in range', count(*) FILTER (WHERE o_totalprice NOT BETWEEN 0 AND 450000), CASE WHEN count(*) FILTER (WHERE o_totalprice NOT BETWEEN 0 AND 450000) = 0 THEN 'pass' ELSE 'REVIEW' END FROM orders
 UNION ALL SELECT 'known status', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')), 'pass' FROM orders
 UNION ALL SELECT 'urgent and tiny', count(*) FILTER (WHERE o_orderpriority LIKE '1%' AND o_totalprice < 2000), CASE WHEN count(*) FILTER (WHERE o_orderpriority LIKE '1%' AND o_totalprice < 2000) = 0 THEN 'pass' ELSE 'REVIEW' END FROM orders
 UNION ALL SELECT 'unique o_orderkey', count(*) - count(DISTINCT o_orderkey), 'pass' FROM orders
 UNION ALL SELECT 'o_custkey has one o_orderstatus', count(*), CASE WHEN count(*) = 0 THEN 'pass' ELSE 'REVIEW' END FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)""")
def _(spark, sf):
    price = F.col("o_totalprice")
    return profile.validity_report(read(spark, sf, "orders"), {
        "price is given": price.isNull(), "price in range": ~price.between(0, 450000),
        "known status": ~F.col("o_orderstatus").isin("F", "O", "P"),
        "urgent and tiny": F.col("o_orderpriority").startswith("1") & (price < 2000)},
        unique=["o_orderkey"], one_to_one=("o_custkey", "o_orderstatus"))
