"""Registered queries: proposals, applying them, and auditing the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog import sqltext as q
from sievestone.catalog.register import registry, rounded
from sievestone.catalog.spelling_checks import RULES_SQL, spelled
from sievestone.catalog.tables import MESSY_SQL, SALES_COLUMNS as COLS, SALES_NUMBERS as NUMS, SALES_SQL, SALES_TEXTS, messy, read, sales
from sievestone.operators import apply as ap
from sievestone.operators import detect, grade, inject
from sievestone.operators import propose as pr
from sievestone.operators.knn import like_row_cells
from sievestone.operators.prepare import prepare
from sievestone.operators.spelling import analyse_spelling
from sievestone.plans.audit import audit, repair
from sievestone.session import cut_lineage

QUERIES, SQL, query = registry()

PARTS_SQL = f"""items AS (SELECT p_partkey AS row_id, p_size::DOUBLE AS size, p_retailprice AS price, (p_partkey % 97)::DOUBLE AS shelf FROM part),
 {q.with_missing('items', 'dirty', ['size', 'price', 'shelf'], ['size', 'price', 'shelf'], 0.05, 3)}"""


def parts(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("size"),
                                          F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 97).cast("double").alias("shelf"))


def dirty_parts(spark, sf):
    return inject.inject_missing(parts(spark, sf), "row_id", ["size", "price", "shelf"], 0.05, 3).frame


PART_COLUMNS = ["size", "price", "shelf"]


def _likeness(column: str) -> str:
    """CTEs of one column: its mean by the deciles of the other two, the one more correlated with it first, and the filled cells."""
    a, b = (c for c in PART_COLUMNS if c != column)
    swap = f"round(abs(corr({column}, {b})), 6) > round(abs(corr({column}, {a})), 6)"
    return f"""o_{column} AS (SELECT {swap} AS swap, quantile_cont({column}, 0.5) AS middle FROM dirty),
 k_{column} AS (SELECT row_id, {column} AS v, middle, CASE WHEN swap THEN {b}_d ELSE {a}_d END AS first, CASE WHEN swap THEN {a}_d ELSE {b}_d END AS second FROM coded, o_{column}),
 f_{column} AS (SELECT first, second, avg(v) AS m FROM k_{column} WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
 g_{column} AS (SELECT first, avg(v) AS m FROM k_{column} WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
 r_{column} AS (SELECT row_id, '{column}' AS "column", coalesce(f.m, g.m, middle) AS value FROM k_{column} k LEFT JOIN f_{column} f USING (first, second)
  LEFT JOIN g_{column} g USING (first) WHERE v IS NULL)"""


KNN_SQL = (PARTS_SQL + ", cuts AS (SELECT " + ", ".join(f"quantile_cont({c}, [{', '.join(f'0.{k}' for k in range(1, 10))}]) AS {c}_q" for c in PART_COLUMNS) + " FROM dirty),\n coded AS (SELECT dirty.*, "
           + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + len(list_filter({c}_q, lambda x: x < {c})) END AS {c}_d" for c in PART_COLUMNS) + " FROM dirty, cuts),\n "
           + ",\n ".join(map(_likeness, PART_COLUMNS)) + ",\n knn AS (" + " UNION ALL ".join(f"SELECT * FROM r_{c}" for c in PART_COLUMNS) + ")")


@query("impute_nearest_rows", f"WITH {KNN_SQL} SELECT row_id, \"column\", round(value, 4) AS value FROM knn")
def _(spark, sf):
    return rounded(like_row_cells(dirty_parts(spark, sf), "row_id", ["size", "price", "shelf"]), 4)


@query("impute_integer_rounding", f"WITH {KNN_SQL} SELECT row_id, round_even(value, 0)::DOUBLE AS proposed_number FROM knn WHERE \"column\" = 'size'")
def _(spark, sf):
    proposals = pr.propose_missing(prepare(dirty_parts(spark, sf), "row_id"))
    return proposals.filter("column = 'size'").select("row_id", "proposed_number")


MIX = f"WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', COLS, COLS, 0.05, 7)} "


@query("impute_median_and_mode", MIX + ", m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMS) + ", " + ", ".join(
    f"(SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for c in SALES_TEXTS) + " FROM dirty) " + " UNION ALL ".join(
    [f"SELECT row_id, '{c}' AS \"column\", NULL AS text, {'round_even(m.nation, 0)' if c == 'nation' else f'round(m.{c}, 2)'}::DOUBLE AS number FROM dirty d, m WHERE d.{c} IS NULL" for c in NUMS]
    + [f"SELECT row_id, '{c}', m.{c}, NULL FROM dirty d, m WHERE d.{c} IS NULL" for c in SALES_TEXTS]))
def _(spark, sf):
    dirty = inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7).frame
    out = pr.propose_missing(prepare(dirty, "row_id"), knn=False)
    return out.select("row_id", "column", F.when(F.col("proposed_number").isNull(), F.col("proposed_value")).alias("text"),
                      F.round("proposed_number", 2).alias("number"))


@query("point_mass_columns", """WITH t AS (SELECT CASE WHEN o_orderkey % 10 < 6 THEN 0.0 ELSE o_totalprice END AS zero_heavy, o_totalprice AS price FROM orders)
 SELECT 'zero_heavy' AS "column", (SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY zero_heavy)) >= 0.5 * count(*) AS is_point_mass FROM t UNION ALL
 SELECT 'price', (SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY price)) >= 0.5 * count(*) FROM t""")
def _(spark, sf):
    frame = read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 < 6, 0.0).otherwise(F.col("o_totalprice")).alias("zero_heavy"),
                                             F.col("o_totalprice").alias("price"))
    from sievestone.operators.quantiles import medians

    found = pr.point_mass_columns(frame, ["zero_heavy", "price"], medians(frame, ["zero_heavy", "price"]))
    return spark.createDataFrame([(c, c in found) for c in ("zero_heavy", "price")], "column string, is_point_mass boolean")


@query("propose_duplicate_removal", f"""WITH {SALES_SQL}, {q.with_duplicates('sales', 'dirty', COLS, 0.05, 13)} SELECT row_id, 'same record as row ' || first_row AS original_value, 'drop row' AS proposed_value
 FROM (SELECT row_id, min(row_id) OVER (PARTITION BY {', '.join(COLS)}) AS first_row FROM dirty) WHERE row_id <> first_row""")
def _(spark, sf):
    dirty = inject.inject_duplicates(sales(spark, sf), "row_id", 0.05, 13).frame
    return pr.propose_duplicates(prepare(dirty, "row_id")).select("row_id", "original_value", "proposed_value")


OUT = f"WITH {SALES_SQL}, {q.with_outliers('sales', 'dirty', COLS, NUMS, 0.04, 11)}, {q.fences('dirty', 'f', NUMS)}, {q.fences('dirty', 'g', NUMS, 3.0, (0.001, 0.999))} "
CLIP = OUT + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS \"column\", CASE WHEN {c} < g.lo OR {c} > g.hi THEN 'strict' ELSE 'loose' END AS tier, "
    f"CASE WHEN {c} < g.lo OR {c} > g.hi THEN round(greatest(f.lo, least(f.hi, {c})), 2) END AS proposed_number FROM dirty, f, g "
    f"WHERE f.col = '{c}' AND g.col = '{c}' AND ({c} < f.lo OR {c} > f.hi)" for c in NUMS)


@query("propose_outlier_clipping", CLIP)
def _(spark, sf):
    prepared = prepare(inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11).frame, "row_id")
    loose, strict = detect.fences(prepared.frame, NUMS, ((detect.FLAG_K, detect.FLAG_TAILS), (detect.STRICT_K, detect.STRICT_TAILS)))
    out = pr.propose_outliers(prepared, loose, strict)
    return rounded(out.select("row_id", "column", "tier", "proposed_number"), 2)


@query("propose_spelling_merges", RULES_SQL + """SELECT s.row_id, f.col AS "column", f.proposed AS proposed_value, f.tier FROM spelled s JOIN flags f ON (f.col = 'segment' AND f.value = s.segment)
 OR (f.col = 'nation' AND f.value = s.nation)""")
def _(spark, sf):
    prepared = prepare(spelled(spark, sf), "row_id")
    out = pr.propose_spelling(prepared, analyse_spelling(prepared.frame, prepared.texts))
    return out.select("row_id", "column", "proposed_value", "tier")


@query("winsorise", """WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT o_orderkey, round(greatest(lo, least(hi, o_totalprice)), 2) AS price FROM orders, b""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    lo, hi = detect.quantiles(orders, {"p": (F.col("o_totalprice"), [0.01, 0.99])})["p"]
    return orders.select("o_orderkey", F.round(detect.Fence(lo, hi, True).clip(F.col("o_totalprice")), 2).alias("price"))


@query("domain_repair", f"""WITH {SALES_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY {q.md5_of(41, 'row_id')}) AS rn, floor(count(*) OVER () * 0.03::DOUBLE + 1e-9) AS k FROM sales),
 d AS (SELECT row_id, status, CASE WHEN rn <= 2 * k THEN NULL ELSE balance END AS balance FROM ranked), m AS (SELECT quantile_cont(b, 0.5) AS mid FROM (SELECT balance AS b FROM d UNION ALL
  SELECT balance FROM ranked WHERE rn > 2 * k AND rn <= 3 * k)) SELECT row_id, round(coalesce(balance, mid), 2) AS balance FROM d, m""")
def _(spark, sf):
    dirty = inject.inject_classroom(sales(spark, sf), "row_id", "balance", 99999.0, 0.03, 41)
    possible = dirty.withColumn("balance", F.when(F.col("balance") < 50000, F.col("balance")))
    middle = detect.quantiles(possible, {"b": (F.col("balance"), [0.5])})["b"][0]
    fixed = possible.withColumn("balance", F.coalesce("balance", F.lit(middle))).filter("damage is null or damage <> 'duplicate'")
    return fixed.select("row_id", F.round("balance", 2).alias("balance"))


@query("oracle_repair", f"WITH {SALES_SQL} SELECT row_id, status, round(price, 2) AS price, priority, segment, round(balance, 2) AS balance, nation FROM sales")
def _(spark, sf):
    broken = inject.inject_all(sales(spark, sf), "row_id", COLS, "status", 0.04, 5)
    out = ap.oracle_repair(broken.frame, "row_id", broken.log, COLS)
    return rounded(out.select("row_id", *COLS), 2, ["price", "balance"])


@query("partial_restore", f"""WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', COLS, ['segment', 'balance'], 0.1, 7)}, back AS (SELECT row_id, col FROM dirty_hit WHERE {q.unit(q.md5_of(1, 'row_id', 'col'))} < 0.5)
 SELECT d.row_id, CASE WHEN a.row_id IS NOT NULL THEN s.segment ELSE d.segment END AS segment, CASE WHEN b.row_id IS NOT NULL THEN s.balance ELSE d.balance END AS balance FROM dirty d JOIN sales s USING (row_id)
 LEFT JOIN (SELECT row_id FROM back WHERE col = 'segment') a ON a.row_id = d.row_id LEFT JOIN (SELECT row_id FROM back WHERE col = 'balance') b ON b.row_id = d.row_id""")
def _(spark, sf):
    broken = inject.inject_missing(sales(spark, sf), "row_id", ["segment", "balance"], 0.1, 7)
    return ap.partial_restore(broken.frame, "row_id", broken.log, COLS, portion=0.5, seed=1).select("row_id", "segment", "balance")


@query("imputation_quality", MIX + """, m AS (SELECT quantile_cont(balance, 0.5) AS mid FROM dirty) SELECT 'balance' AS "column", count(*) AS cells, round(avg((s.balance = mid)::INT), 6) AS exact_share,
 round(avg(abs(s.balance - mid)), 2) AS mean_error, round(avg((mid NOT IN (SELECT balance FROM dirty WHERE balance IS NOT NULL))::INT), 6) AS novel_share FROM sales s JOIN dirty_hit h ON h.row_id = s.row_id AND h.col = 'balance' CROSS JOIN m""")
def _(spark, sf):
    broken = inject.inject_missing(cut_lineage(sales(spark, sf)), "row_id", COLS, 0.05, 7)
    dirty = cut_lineage(broken.frame)
    filled = pr.propose_missing(prepare(dirty, "row_id"), knn=False).filter("column = 'balance'").select("row_id", "column", "proposed_number")
    known = dirty.select(F.col("balance").alias("proposed_number")).distinct().withColumn("seen", F.lit(True))
    truth = broken.log.select("row_id", "column", F.col("original_value").cast("double").alias("truth"))
    joined = filled.join(truth, ["row_id", "column"]).join(known, "proposed_number", "left")
    return joined.groupBy("column").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.avg((F.col("truth") == F.col("proposed_number")).cast("int")), 6).alias("exact_share"),
        F.round(F.avg(F.abs(F.col("truth") - F.col("proposed_number"))), 2).alias("mean_error"),
        F.round(F.avg(F.col("seen").isNull().cast("int")), 6).alias("novel_share"))


# --- applying ----------------------------------------------------------------------------------------------------
BROKEN = f"""{SALES_SQL}, {q.with_outliers('sales', 'moved', COLS, NUMS, 0.04, 11)}, {q.with_missing('moved', 'gappy', COLS, COLS, 0.03, 7)}, {q.with_duplicates('gappy', 'dirty', COLS, 0.03, 13)}"""
FIX = f"""WITH {BROKEN}, {q.fences('dirty', 'f', NUMS)}, {q.fences('dirty', 'g', NUMS, 3.0, (0.001, 0.999))}, md AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in NUMS)}, {', '.join(
    f'(SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}' for c in SALES_TEXTS)} FROM dirty),
 kept AS (SELECT row_id, {', '.join(COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(COLS)} ORDER BY row_id) AS rn FROM dirty) WHERE rn = 1) """


def broken(spark, sf):
    moved = inject.inject_outliers(cut_lineage(sales(spark, sf)), "row_id", COLS, 0.04, 11).frame
    gappy = cut_lineage(inject.inject_missing(moved, "row_id", COLS, 0.03, 7).frame)
    return cut_lineage(inject.inject_duplicates(gappy, "row_id", 0.03, 13).frame)


def fixed(spark, sf, issues):
    state = audit(broken(spark, sf), "row_id", detectors={"missing_values", "duplicates", "outliers"}, knn=False)
    return state, ap.apply_proposals(state.prepared, state.proposals, issues, issues, policy=state.policy)


ALL_THREE = {"missing_values", "duplicates", "outliers"}


def _final(c):
    if c in SALES_TEXTS:
        return f"coalesce(k.{c}, md.{c}) AS {c}"
    bound = lambda t, side: f"(SELECT {side} FROM {t} WHERE col = '{c}')"
    return (f"round(CASE WHEN k.{c} IS NULL THEN md.{c} WHEN k.{c} < {bound('g', 'lo')} OR k.{c} > {bound('g', 'hi')} THEN greatest({bound('f', 'lo')}, least({bound('f', 'hi')}, k.{c})) ELSE k.{c} END, 1) AS {c}")


@query("apply_repairs_cleaned_table", FIX + f"SELECT row_id, {', '.join(_final(c) for c in COLS)} FROM kept k, md")
def _(spark, sf):
    _, out = fixed(spark, sf, ALL_THREE)
    return rounded(out.cleaned.select("row_id", *COLS), 1, NUMS)


GAPS = " + ".join(f"({c} IS NULL)::INT" for c in COLS)


@query("repair_log_actions", FIX + f""", dup AS (SELECT * FROM dirty ANTI JOIN kept USING (row_id)), o AS ({' UNION ALL '.join(
    f"SELECT row_id, {c} < (SELECT lo FROM g WHERE col = '{c}') OR {c} > (SELECT hi FROM g WHERE col = '{c}') AS far FROM dirty WHERE {c} < (SELECT lo FROM f WHERE col = '{c}') OR {c} > (SELECT hi FROM f WHERE col = '{c}')" for c in NUMS)})
 SELECT 'missing_values' AS issue_key, 'applied' AS action, sum({GAPS})::BIGINT AS n FROM kept UNION ALL SELECT 'missing_values', 'skipped_row_dropped', sum({GAPS})::BIGINT FROM dup UNION ALL
 SELECT 'duplicates', 'applied', count(*) FROM dup UNION ALL SELECT 'outliers', 'flagged_only', count(*) FROM o WHERE NOT far HAVING count(*) > 0 UNION ALL
 SELECT 'outliers', 'applied', count(*) FROM o SEMI JOIN kept USING (row_id) WHERE far UNION ALL SELECT 'outliers', 'skipped_row_dropped', count(*) FROM o SEMI JOIN dup USING (row_id) WHERE far HAVING count(*) > 0""")
def _(spark, sf):
    _, out = fixed(spark, sf, ALL_THREE)
    return out.log.groupBy("issue_key", "action").agg(F.count(F.lit(1)).alias("n"))


@query("repair_log_audit", "SELECT unnest(['changed_without_log', 'logged_value_not_stored', 'dropped_without_log', 'logged_drop_still_present']) AS \"check\", 0::BIGINT AS violations")
def _(spark, sf):
    state, out = fixed(spark, sf, ALL_THREE)
    return ap.audit_log(state.prepared.source, out, "row_id", COLS)


def _unusual(c):
    """Values beyond the quartile fences but inside the wide ones: flagged, never clipped."""
    side = lambda t, name: f"(SELECT {name} FROM {t} WHERE col = '{c}')"
    outside = lambda t: f"({c} < {side(t, 'lo')} OR {c} > {side(t, 'hi')})"
    return f"SELECT row_id, 'outliers' AS issue_key, 'flagged_only' AS action FROM dirty WHERE {outside('f')} AND NOT {outside('g')}"


REVIEW = FIX + ", work AS (SELECT row_id, 'duplicates' AS issue_key, 'flagged_for_review' AS action FROM dirty ANTI JOIN kept USING (row_id) UNION ALL " + " UNION ALL ".join(map(_unusual, NUMS)) + ") "


@query("review_summary", REVIEW + f"""SELECT issue_key, CASE issue_key WHEN 'duplicates' THEN '{pr.PROBLEMS['duplicates']}' ELSE '{pr.PROBLEMS['outliers']}' END AS problem,
 count(*) FILTER (action = 'flagged_for_review') AS proposed, count(*) FILTER (action = 'flagged_only') AS flag_only FROM work GROUP BY issue_key""")
def _(spark, sf):
    _, out = fixed(spark, sf, {"missing_values", "outliers"})
    return ap.review_summary(out.log)


@query("review_worklist", REVIEW + "SELECT * FROM work")
def _(spark, sf):
    _, out = fixed(spark, sf, {"missing_values", "outliers"})
    return ap.review_worklist(out.log).select("row_id", "issue_key", "action")


@query("repair_log_page")
def _(spark, sf):
    _, out = fixed(spark, sf, ALL_THREE)
    return ap.log_page(out.log, action="applied", issue="missing_values", offset=100, size=50)


FIXES = " UNION ALL ".join([f"SELECT row_id FROM dirty WHERE {c} IS NULL" for c in COLS] + [
    f"SELECT row_id FROM dirty WHERE {c} < (SELECT lo FROM g WHERE col = '{c}') OR {c} > (SELECT hi FROM g WHERE col = '{c}')" for c in NUMS])


@query("run_summary", REVIEW + f""", fixes AS ({FIXES}), said AS (SELECT 'rows_uploaded' AS metric, count(*) AS value FROM dirty UNION ALL SELECT 'rows_after_cleaning', count(*) FROM kept
 UNION ALL SELECT 'cells_modified', count(*) FROM fixes SEMI JOIN kept USING (row_id) UNION ALL SELECT 'applied', (SELECT count(*) FROM fixes SEMI JOIN kept USING (row_id)) + count(*) FROM dirty ANTI JOIN kept USING (row_id)
 UNION ALL SELECT 'skipped_row_dropped', count(*) FROM fixes ANTI JOIN kept USING (row_id) UNION ALL SELECT 'flagged_only', count(*) FROM work WHERE issue_key = 'outliers') SELECT * FROM said WHERE value > 0""")
def _(spark, sf):
    state, out = fixed(spark, sf, ALL_THREE)
    return ap.run_summary(state.prepared.source, out)


@query("spot_check_sample")
def _(spark, sf):
    _, out = fixed(spark, sf, ALL_THREE)
    return ap.spot_check(out.log, 20, 1)


@query("held_back_codes", f"""WITH {MESSY_SQL} SELECT 'missing_values' AS issue_key, 'balance' AS "column", 'codes' AS reason, count(*) AS cells FROM messy WHERE balance = -999 UNION ALL
 SELECT 'missing_values', 'word', 'codes', count(*) FROM messy WHERE word LIKE 'Unknown%' UNION ALL SELECT 'missing_values', 'text_code', 'codes', count(*) FROM messy WHERE text_code IN ('-9', '-9.0')""")
def _(spark, sf):
    state = audit(messy(spark, sf), "row_id", detectors={"missing_values"})
    out = ap.apply_proposals(state.prepared, state.proposals, {"missing_values"}, hold_codes=True)
    return ap.held_back(state.proposals, out.log, set())


@query("decimal_comma_written_back", f"""WITH {MESSY_SQL}, m AS (SELECT quantile_cont(CAST(replace(comma_price, ',', '.') AS DOUBLE), 0.5) AS v FROM messy WHERE comma_price <> '-')
 SELECT row_id, CASE WHEN comma_price = '-' THEN (SELECT replace(rtrim(rtrim(printf('%.6f', v), '0'), '.'), '.', ',') FROM m) ELSE comma_price END AS comma_price FROM messy""")
def _(spark, sf):
    state = audit(messy(spark, sf).select("row_id", "comma_price", "nation"), "row_id", detectors={"missing_values"}, knn=False)
    return ap.apply_proposals(state.prepared, state.proposals, {"missing_values"}).cleaned.select("row_id", "comma_price")


AFTER_OUTSIDE = " OR ".join(f"{c} < (SELECT lo FROM h WHERE col = '{c}') OR {c} > (SELECT hi FROM h WHERE col = '{c}')" for c in NUMS)
AFTER_VARIANTS = " OR ".join(f"{c} IN (SELECT {c} FROM (SELECT {c}, count(*) OVER (PARTITION BY lower(trim({c}))) AS k FROM (SELECT DISTINCT {c} FROM c)) WHERE k > 1)" for c in SALES_TEXTS)


@query("rates_after_cleaning", FIX + f""", c AS (SELECT row_id, {', '.join(_final(c) for c in COLS)} FROM kept k, md), {q.fences('c', 'h', NUMS)} SELECT 'missing_values' AS issue_key, 0.0::DOUBLE AS rate FROM c GROUP BY 1
 UNION ALL SELECT 'duplicates', round(1 - count(DISTINCT ({', '.join(COLS)})) / count(*)::DOUBLE, 6) FROM c
 UNION ALL SELECT 'outliers', round(count(*) FILTER ({AFTER_OUTSIDE}) / count(*)::DOUBLE, 6) FROM c UNION ALL SELECT 'inconsistency', round(count(*) FILTER ({AFTER_VARIANTS}) / count(*)::DOUBLE, 6) FROM c""")
def _(spark, sf):
    from sievestone.plans.audit import after_cleaning

    state, out = fixed(spark, sf, ALL_THREE)
    return after_cleaning(out.cleaned, state.prepared).select("issue_key", F.round("rate_after_cleaning", 6).alias("rate"))


@query("table_diff", f"""WITH {SALES_SQL}, {q.with_missing('sales', 'dirty', COLS, ['segment', 'balance'], 0.02, 7)} SELECT row_id, 'segment' AS "column" FROM dirty WHERE segment IS NULL UNION ALL
 SELECT row_id, 'balance' FROM dirty WHERE balance IS NULL""")
def _(spark, sf):
    clean = sales(spark, sf)
    dirty = inject.inject_missing(clean, "row_id", ["segment", "balance"], 0.02, 7).frame
    return ap.table_diff(clean, dirty, ["row_id"]).select("row_id", "column")


# --- grading -----------------------------------------------------------------------------------------------------
@query("grade_outlier_detector", OUT + """, found AS (""" + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS col FROM dirty, f WHERE f.col = '{c}' AND ({c} < lo OR {c} > hi)" for c in NUMS) + f"""), truth AS (SELECT row_id, ['price', 'balance', 'nation'][CAST({q.below(q.md5_of('11/column', 'row_id'), 3)} AS BIGINT) + 1] AS col FROM dirty_hit),
 j AS (SELECT count(*) FILTER (WHERE t.row_id IS NOT NULL AND f.row_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.row_id IS NULL) AS fp, count(*) FILTER (WHERE f.row_id IS NULL) AS fn FROM truth t FULL JOIN found f ON t.row_id = f.row_id AND t.col = f.col)
 SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM j""")
def _(spark, sf):
    step = inject.inject_outliers(sales(spark, sf), "row_id", COLS, 0.04, 11)
    found = detect.outlier_cells(step.frame, "row_id", detect.fences(step.frame, NUMS)[0])
    return rounded(grade.precision_recall(step.log, found, ["row_id", "column"]), 6)


@query("grade_median_repair", MIX + """, m AS (SELECT quantile_cont(balance, 0.5) AS mid FROM dirty), r AS (SELECT count(*) AS tp, count(*) FILTER (WHERE CASE WHEN s.balance = 0 THEN abs(mid) < 1e-6 ELSE abs(mid - s.balance) / abs(s.balance) < 0.10 END) AS restored
 FROM sales s JOIN dirty_hit h ON h.row_id = s.row_id AND h.col = 'balance' CROSS JOIN m) SELECT tp, 0::BIGINT AS fp, 0::BIGINT AS fn, restored AS restored_correctly, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM r""")
def _(spark, sf):
    step = inject.inject_missing(sales(spark, sf), "row_id", COLS, 0.05, 7)
    filled = pr.propose_missing(prepare(step.frame, "row_id"), knn=False).filter("column = 'balance'")
    return grade.grade_repair(step.log.filter("column = 'balance'"), filled.select("row_id", "column", F.col("proposed_value").alias("repaired_value")), ["row_id", "column"])


@query("grade_spelling_by_kind")
def _(spark, sf):
    step = inject.inject_spellings(sales(spark, sf), "row_id", SALES_TEXTS, 0.05, 43)
    prepared = prepare(step.frame, "row_id")
    proposals = pr.propose_spelling(prepared, analyse_spelling(prepared.frame, prepared.texts))
    return grade.grade_by_kind(step.log, proposals, proposals.filter("tier = 'strict'").select("row_id", "column", F.col("proposed_value").alias("repaired_value")), ["row_id", "column"])


@query("quality_report", FIX + f""", r AS (SELECT count(*)::DOUBLE AS n, sum({GAPS})::BIGINT AS gaps, count(*) - (SELECT count(*) FROM kept) AS dups FROM dirty),
 o AS (SELECT count(*) AS n FROM dirty WHERE {' OR '.join(f"{c} < (SELECT lo FROM f WHERE col = '{c}') OR {c} > (SELECT hi FROM f WHERE col = '{c}')" for c in NUMS)})
 SELECT 'Completeness' AS dimension, 'missing_values' AS issue_key, 'exact check' AS detector_type, round(gaps / (n * 6), 6) AS detected_rate, gaps AS detected_count, 'cells' AS count_unit FROM r UNION ALL
 SELECT 'Uniqueness', 'duplicates', 'exact check', round(dups / n, 6), dups, 'rows' FROM r UNION ALL SELECT 'Anomaly burden', 'outliers', 'statistical estimate', round(o.n / r.n, 6), o.n, 'rows' FROM r, o UNION ALL
 SELECT 'Consistency', 'inconsistency', 'rule-based check', 0.0, 0, 'rows' UNION ALL SELECT 'Label reliability', 'label_errors', 'statistical estimate', NULL, NULL, 'rows' UNION ALL
 SELECT 'Feature reliability', 'feature_corruption', 'statistical estimate', NULL, NULL, 'rows' UNION ALL SELECT 'Joint plausibility', 'joint_outliers', 'statistical estimate', NULL, NULL, 'rows'""")
def _(spark, sf):
    state = audit(broken(spark, sf), "row_id")
    report = repair(state).quality.select("dimension", "issue_key", "detector_type", "detected_rate", "detected_count", "count_unit")
    return rounded(report, 6)
