"""Registered queries: injectors and model-free detectors on injected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog import sqltext as q
from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import SALES_COLUMNS as COLS
from sievestone.catalog.tables import SALES_NUMBERS as NUMS
from sievestone.catalog.tables import SALES_SQL, SALES_TEXTS, read, sales
from sievestone.operators import detect, inject

QUERIES, SQL, query = registry()

MISSING = f"WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', COLS, COLS, 0.05, 7)} "
OUTLIER = f"WITH {SALES_SQL}, {q.with_outliers('sales', 'dirty', COLS, NUMS, 0.04, 11)} "
DUPS = f"WITH {SALES_SQL}, {q.with_duplicates('sales', 'dirty', COLS, 0.05, 13)} "
SWAPS = f"WITH {SALES_SQL}, {q.with_swaps('sales', 'dirty', COLS, ['segment', 'balance'], 0.04, 17, {})} "


@query("inject_missing_values", MISSING + "SELECT row_id, status, price, priority, segment, balance, nation FROM dirty")
def _(spark, sf):
    return inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).frame


@query("inject_missing_log", MISSING + "SELECT row_id, 'missing_values' AS error_type, col AS \"column\" FROM dirty_hit")
def _(spark, sf):
    return inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).log.select("row_id", "error_type", "column")


@query("inject_duplicates", DUPS + "SELECT row_id, status, price, priority, segment, balance, nation FROM dirty")
def _(spark, sf):
    return inject.inject_duplicates(sales(spark, sf), "row_id", 0.05, 13).frame


@query("inject_outliers", OUTLIER + """SELECT row_id, status, round(price, 2) AS price, priority, segment,
 round(balance, 2) AS balance, round(nation, 4) AS nation FROM dirty""")
def _(spark, sf):
    frame = inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11).frame
    return frame.withColumns({"price": F.round("price", 2), "balance": F.round("balance", 2), "nation": F.round("nation", 4)})


LABEL_HASH = q.md5_of("19/class", "b.row_id")


@query("inject_label_errors", f"""WITH {SALES_SQL}, {q.picked_rows('sales', 'hit', 0.1, 19)},
 classes AS (SELECT list(status ORDER BY status) AS all_classes FROM (SELECT DISTINCT status FROM sales))
 SELECT b.row_id, CASE WHEN hit.row_id IS NULL THEN b.status ELSE list_filter(all_classes, lambda c: c <> b.status)
  [CAST({q.below(LABEL_HASH, '(len(all_classes) - 1)')} AS BIGINT) + 1] END AS status
 FROM sales b CROSS JOIN classes LEFT JOIN hit ON hit.row_id = b.row_id""")
def _(spark, sf):
    return inject.inject_labels(sales(spark, sf), "row_id", "status", 0.1, 19).frame.select("row_id", "status")


SHIFT_HASH = q.md5_of("23/shift", "b.row_id")


@query("inject_target_errors", f"""WITH {SALES_SQL}, {q.picked_rows('sales', 'hit', 0.1, 23)},
 sd AS (SELECT stddev_pop(price) AS s FROM sales)
 SELECT b.row_id, round(CASE WHEN hit.row_id IS NULL THEN b.price ELSE b.price + (1.0 + {q.unit(SHIFT_HASH)} * 2.0)
  * CASE WHEN {q.below(SHIFT_HASH, 2, 9)} = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * s END, 2) AS price
 FROM sales b CROSS JOIN sd LEFT JOIN hit ON hit.row_id = b.row_id""")
def _(spark, sf):
    frame = inject.inject_target_shift(sales(spark, sf), "row_id", "price", 0.1, 23).frame
    return frame.select("row_id", F.round("price", 2).alias("price"))


@query("inject_feature_corruption", SWAPS + "SELECT row_id, status, price, priority, segment, balance, nation FROM dirty")
def _(spark, sf):
    return inject.inject_swaps(sales(spark, sf), "row_id", ["segment", "balance"], 0.04, 17).frame


@query("corruption_log_ids", MISSING + f"""SELECT printf('C%06d', row_number() OVER (ORDER BY
 {q.md5_of('stamp', 'row_id', 'col')})) AS corruption_id, row_id, col AS "column", 0.05::DOUBLE AS rate FROM dirty_hit""")
def _(spark, sf):
    log = inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).log
    return inject.stamp(log, 0.05).select("corruption_id", "row_id", "column", "rate")


@query("inject_random_flips", f"""WITH {SALES_SQL}, classes AS (SELECT list(status ORDER BY status) AS all_classes
 FROM (SELECT DISTINCT status FROM sales))
 SELECT b.row_id, CASE WHEN {q.unit(q.md5_of(29, 'b.row_id'))} >= 0.05 THEN b.status ELSE
 list_filter(all_classes, lambda c: c <> b.status)[CAST({q.below(q.md5_of('29/class', 'b.row_id'), '(len(all_classes) - 1)')}
 AS BIGINT) + 1] END AS status FROM sales b CROSS JOIN classes""")
def _(spark, sf):
    return inject.flip_labels(sales(spark, sf), "row_id", "status", 0.05, 29).frame.select("row_id", "status")


@query("inject_planted_codes", f"""WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', COLS, ['balance'], 0.03, 31, '-999.0::DOUBLE')}
 SELECT row_id, balance FROM dirty""")
def _(spark, sf):
    return inject.inject_missing(sales(spark, sf), "row_id", ["balance"], 0.03, 31, literal=-999.0).frame.select("row_id", "balance")


@query("mask_cells_at_random", f"""WITH {SALES_SQL} SELECT row_id,
 CASE WHEN {q.unit(q.md5_of(37, 'row_id', "'segment'"))} < 0.1 THEN NULL ELSE segment END AS segment,
 CASE WHEN {q.unit(q.md5_of(37, 'row_id', "'balance'"))} < 0.1 THEN NULL ELSE balance END AS balance FROM sales""")
def _(spark, sf):
    return inject.mask_at_random(sales(spark, sf), "row_id", ["segment", "balance"], 0.1, 37).frame.select("row_id", "segment", "balance")


@query("inject_classroom_damage", f"""WITH {SALES_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY {q.md5_of(41, 'row_id')}) AS rn,
  floor(count(*) OVER () * 0.03::DOUBLE + 1e-9) AS k FROM sales), d AS (SELECT row_id, CASE WHEN rn <= k THEN NULL WHEN rn <= 2 * k THEN 99999.0
  ELSE balance END AS balance, CASE WHEN rn <= k THEN 'missing' WHEN rn <= 2 * k THEN 'impossible' END AS damage, rn, k FROM ranked)
 SELECT row_id, balance, damage FROM d UNION ALL SELECT row_id + (SELECT max(row_id) - min(row_id) + 1 FROM sales), balance, 'duplicate'
 FROM d WHERE rn > 2 * k AND rn <= 3 * k""")
def _(spark, sf):
    return inject.inject_classroom(sales(spark, sf), "row_id", "balance", 99999.0, 0.03, 41).select("row_id", "balance", "damage")


@query("inject_combined_errors")
def _(spark, sf):
    return inject.inject_all(sales(spark, sf), "row_id", COLS, "status", 0.05, 42).log.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("changed"))


@query("add_irrelevant_columns", f"""WITH {SALES_SQL} SELECT row_id, 'key-' || row_id AS junk_text_key, CAST(row_id AS DOUBLE) AS junk_number_key,
 CAST({q.number_at(q.md5_of('5/key', 'row_id'))} AS DOUBLE) AS junk_random_key, 7.0::DOUBLE - 2.0::DOUBLE * price AS junk_turned, price AS junk_twin, 'only' AS junk_fixed,
 ['a', 'b', 'c', 'd'][CAST({q.below(q.md5_of('5/few', 'row_id'), 4)} AS BIGINT) + 1] AS junk_few, 'group ' || {q.below(q.md5_of('5/many', 'row_id'), 25)} AS junk_many,
 CAST({q.below(q.md5_of('5/whole', 'row_id'), 500)} AS DOUBLE) AS junk_whole FROM sales""")
def _(spark, sf):
    wide = inject.add_irrelevant_columns(sales(spark, sf), "row_id", "price", 5)
    return wide.select("row_id", *[c for c in wide.columns if c.startswith("junk_") and c != "junk_normal"])


@query("inject_joint_outliers")
def _(spark, sf):
    items = read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("size"),
                                           F.col("p_retailprice").alias("price"))
    return inject.inject_joint(items, "row_id", ["size", "price"], 0.1, 3).log.groupBy("kind", "invisible").agg(
        F.count(F.lit(1)).alias("cells"))


@query("inject_inconsistent_spellings")
def _(spark, sf):
    log = inject.inject_spellings(sales(spark, sf), "row_id", SALES_TEXTS, 0.05, 43).log
    return log.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("cells"))


# --- detectors ---------------------------------------------------------------------------------------------------
@query("detect_missing_rate", MISSING + f"""SELECT sum({' + '.join(f'({c} IS NULL)::INT' for c in COLS)})::BIGINT AS missing_cells,
 count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in COLS)}) AS rows_with_missing, count(*) AS rows,
 round(sum({' + '.join(f'({c} IS NULL)::INT' for c in COLS)}) / (count(*) * 6.0), 6) AS rate FROM dirty""")
def _(spark, sf):
    dirty = inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).frame
    return rounded(detect.missing_rates(dirty, COLS), 6)


@query("detect_missing_by_column", MISSING + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, round(count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE, 6) AS rate FROM dirty" for c in COLS))
def _(spark, sf):
    dirty = inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).frame
    return rounded(detect.missing_by_column(dirty, COLS), 6)


@query("detect_missing_cells", MISSING + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS \"column\" FROM dirty WHERE {c} IS NULL" for c in COLS))
def _(spark, sf):
    dirty = inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).frame
    return detect.missing_cells(dirty, "row_id", COLS)


@query("detect_duplicate_rows", DUPS + f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {', '.join(COLS)}
 ORDER BY row_id) AS rn FROM dirty) WHERE rn > 1""")
def _(spark, sf):
    dirty = inject.inject_duplicates(sales(spark, sf), "row_id", 0.05, 13).frame
    return detect.duplicate_rows(dirty, "row_id", COLS)


@query("detect_duplicates_with_first", DUPS + f"""SELECT row_id, first_row FROM (SELECT row_id, min(row_id) OVER (PARTITION BY
 {', '.join(COLS)}) AS first_row FROM dirty) WHERE row_id <> first_row""")
def _(spark, sf):
    dirty = inject.inject_duplicates(sales(spark, sf), "row_id", 0.05, 13).frame
    return detect.duplicates_with_first(dirty, "row_id", COLS)


@query("document_duplicate_rate", """SELECT count(*) - count(DISTINCT (text, lang)) AS duplicate_rows, count(*) AS rows,
 round((count(*) - count(DISTINCT (text, lang))) / count(*)::DOUBLE, 6) AS rate FROM documents""")
def _(spark, sf):
    return rounded(detect.duplicate_rate(read(spark, sf, "documents"), ["text", "lang"]), 6)


@query("detect_outlier_fences", OUTLIER + f", {q.fences('dirty', 'f', NUMS)} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(any_value(lo), 2) AS low, round(any_value(hi), 2) AS high, any_value(by_tails) AS by_tails, "
    f"count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS flagged_cells FROM dirty, f WHERE f.col = '{c}'" for c in NUMS))
def _(spark, sf):
    dirty = inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11).frame
    return rounded(detect.outliers_by_column(dirty, detect.fences(dirty, NUMS)[0]), 2)


@query("detect_outlier_cells", OUTLIER + f", {q.fences('dirty', 'f', NUMS)} " + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS \"column\", round({c}, 2) AS value FROM dirty, f WHERE f.col = '{c}' AND ({c} < lo OR {c} > hi)" for c in NUMS))
def _(spark, sf):
    dirty = inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11).frame
    return rounded(detect.outlier_cells(dirty, "row_id", detect.fences(dirty, NUMS)[0]), 2)


@query("lineitem_outlier_rate", f"""WITH {q.fences('lineitem', 'f', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])},
 b AS (SELECT max(lo) FILTER (col = 'l_quantity') AS lq, max(hi) FILTER (col = 'l_quantity') AS hq,
  max(lo) FILTER (col = 'l_extendedprice') AS lp, max(hi) FILTER (col = 'l_extendedprice') AS hp,
  max(lo) FILTER (col = 'l_discount') AS ld, max(hi) FILTER (col = 'l_discount') AS hd,
  max(lo) FILTER (col = 'l_tax') AS lt, max(hi) FILTER (col = 'l_tax') AS ht FROM f),
 t AS (SELECT (l_quantity < lq OR l_quantity > hq)::INT AS a, (l_extendedprice < lp OR l_extendedprice > hp)::INT AS p,
  (l_discount < ld OR l_discount > hd)::INT AS d, (l_tax < lt OR l_tax > ht)::INT AS x FROM lineitem, b)
 SELECT count(*) FILTER (WHERE a + p + d + x > 0) AS outlier_rows, sum(a + p + d + x)::BIGINT AS outlier_cells, count(*) AS rows,
  round(count(*) FILTER (WHERE a + p + d + x > 0) / count(*)::DOUBLE, 6) AS rate FROM t""")
def _(spark, sf):
    items = read(spark, sf, "lineitem")
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(detect.outlier_rates(items, detect.fences(items, numbers)[0]), 6)


@query("zscore_outliers", OUTLIER + ", s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMS) + " FROM dirty), z AS (SELECT " + ", ".join(
    f"abs(({c} - m_{c}) / s_{c}) > 3.0 AS z_{c}" for c in NUMS) + " FROM dirty, s) SELECT '*' AS \"column\", count(*) FILTER (WHERE "
    + " OR ".join(f"z_{c}" for c in NUMS) + ") AS flagged FROM z" + "".join(
    f" UNION ALL SELECT '{c}', count(*) FILTER (WHERE z_{c}) FROM z" for c in NUMS))
def _(spark, sf):
    dirty = inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11).frame
    return detect.zscore_rates(dirty, NUMS)


@query("compare_outlier_rules", OUTLIER + f""", s AS (SELECT avg(balance) AS m, stddev_samp(balance) AS sd, quantile_cont(balance, 0.25) AS q1,
 quantile_cont(balance, 0.75) AS q3, quantile_cont(balance, 0.01) AS t1, quantile_cont(balance, 0.99) AS t2 FROM dirty),
 m AS (SELECT d.row_id, abs(balance - m) / sd > 3.0 AS z, balance < q1 - 1.5 * (q3 - q1) OR balance > q3 + 1.5 * (q3 - q1) AS i,
  balance < t1 OR balance > t2 AS p, k.row_id IS NOT NULL AS wrong FROM dirty d CROSS JOIN s LEFT JOIN
  (SELECT row_id FROM dirty_hit WHERE {q.below(q.md5_of('11/column', 'row_id'), 3)} = 1) k ON k.row_id = d.row_id),
 r AS (SELECT 'z-score' AS rule, count(*) FILTER (WHERE z AND wrong) AS hits, count(*) FILTER (WHERE z AND NOT wrong) AS false_alarms,
  count(*) FILTER (WHERE wrong) AS wrong_rows FROM m UNION ALL SELECT 'quartiles', count(*) FILTER (WHERE i AND wrong),
  count(*) FILTER (WHERE i AND NOT wrong), count(*) FILTER (WHERE wrong) FROM m UNION ALL SELECT 'percentiles',
  count(*) FILTER (WHERE p AND wrong), count(*) FILTER (WHERE p AND NOT wrong), count(*) FILTER (WHERE wrong) FROM m)
 SELECT *, round(CASE WHEN hits + false_alarms > 0 THEN hits / (hits + false_alarms)::DOUBLE END, 6) AS precision,
  round(CASE WHEN wrong_rows > 0 THEN hits / wrong_rows::DOUBLE END, 6) AS recall FROM r""")
def _(spark, sf):
    step = inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11)
    return detect.compare_outlier_rules(step.frame, step.log.filter("column = 'balance'"), "row_id", "balance")


CASED = f"""WITH {SALES_SQL}, cased AS (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN lower(segment) WHEN row_id % 13 = 0 THEN
 segment || ' ' ELSE segment END AS segment, CASE WHEN row_id % 17 = 0 THEN lower(priority) ELSE priority END AS priority FROM sales),
 v AS (SELECT 'segment' AS "column", segment AS value, count(*) AS n FROM cased GROUP BY 2 UNION ALL
  SELECT 'priority', priority, count(*) FROM cased GROUP BY 2),
 m AS (SELECT *, count(*) OVER (PARTITION BY "column", lower(trim(value))) AS spellings FROM v) """


def _cased(spark, sf):
    return sales(spark, sf).select(
        "row_id", F.when(F.col("row_id") % 11 == 0, F.lower("segment")).when(F.col("row_id") % 13 == 0, F.concat("segment", F.lit(" ")))
        .otherwise(F.col("segment")).alias("segment"),
        F.when(F.col("row_id") % 17 == 0, F.lower("priority")).otherwise(F.col("priority")).alias("priority"))


@query("detect_case_variants", CASED + 'SELECT "column", value, n, spellings FROM m WHERE spellings > 1')
def _(spark, sf):
    return detect.case_variants(_cased(spark, sf), ["segment", "priority"])


@query("case_variant_rate", CASED + """, f AS (SELECT count(*) AS rows, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m WHERE spellings > 1 AND
 (("column" = 'segment' AND value = c.segment) OR ("column" = 'priority' AND value = c.priority)))) AS variant_rows FROM cased c)
 SELECT variant_rows, rows, round(variant_rows / rows::DOUBLE, 6) AS rate FROM f""")
def _(spark, sf):
    return rounded(detect.case_variant_rate(_cased(spark, sf), ["segment", "priority"]), 6)
