"""Registered queries: evidence, policy, readiness and priorities over runs aggregated from the order tables.

A run here is a group of line items: its scores are means over the group, so the tables grow with the data and every
rule meets realistic signs and magnitudes. The odd factors keep means off the rounding boundaries of the comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import read
from sievestone.operators import grade, policy

QUERIES, SQL, query = registry()

RUNS_SQL = """runs AS (SELECT issue, rate, seed, clean, dirty, repaired, oracle, round(clean - dirty, 12) AS damage, round(repaired - dirty, 12) AS recovery,
  damage_auc, recovery_auc, detected_rate, repair_precision, repair_recall, issue = 'duplicates' AS restored_exactly FROM (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'missing_values' WHEN '2-HIGH' THEN 'duplicates' WHEN '3-MEDIUM' THEN 'outliers' WHEN '4-NOT SPECIFIED' THEN 'label_errors' ELSE 'feature_corruption' END AS issue,
   CASE l_linenumber % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS rate, (l_suppkey % 5)::INT AS seed, round(0.7 + avg(l_discount * 0.98765432173), 12) AS clean, round(0.7 + avg(l_tax * 0.98765432173), 12) AS dirty,
   round(0.7 + avg(l_tax * 0.98765432173) + (avg(l_quantity * 0.98765432173) - 25.5) / 100, 12) AS repaired, round(0.7 + avg(l_discount * 0.98765432173) * 0.98, 12) AS oracle, round(avg(l_discount * 0.98765432173) - 1.1 * avg(l_tax * 0.98765432173), 12) AS damage_auc,
   round((avg(l_quantity * 0.98765432173) - 25.4) / 120, 12) AS recovery_auc, round(avg((l_returnflag = 'R')::INT * 0.98765432173), 12) AS detected_rate, round(avg((l_quantity > 2)::INT * 0.99765432173), 12) AS repair_precision,
   round(avg((l_linestatus = 'O')::INT * 0.98765432173), 12) AS repair_recall FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3))"""


def runs(spark, sf):
    priority = F.col("o_orderpriority")
    issue = (F.when(priority == "1-URGENT", "missing_values").when(priority == "2-HIGH", "duplicates").when(priority == "3-MEDIUM", "outliers")
             .when(priority == "4-NOT SPECIFIED", "label_errors").otherwise("feature_corruption"))
    third = F.col("l_linenumber") % 3
    rate = F.when(third == 0, 0.05).when(third == 1, 0.1).otherwise(0.2)
    discount, tax, quantity = (F.avg(F.col(c) * 0.98765432173) for c in ("l_discount", "l_tax", "l_quantity"))
    share = lambda c, k=0.98765432173: F.round(F.avg(c.cast("int") * k), 12)
    grouped = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        issue.alias("issue"), rate.alias("rate"), (F.col("l_suppkey") % 5).cast("int").alias("seed")).agg(
        F.round(0.7 + discount, 12).alias("clean"), F.round(0.7 + tax, 12).alias("dirty"), F.round(0.7 + tax + (quantity - 25.5) / 100, 12).alias("repaired"),
        F.round(0.7 + discount * 0.98, 12).alias("oracle"), F.round(discount - 1.1 * tax, 12).alias("damage_auc"), F.round((quantity - 25.4) / 120, 12).alias("recovery_auc"),
        share(F.col("l_returnflag") == "R").alias("detected_rate"), share(F.col("l_quantity") > 2, 0.99765432173).alias("repair_precision"), share(F.col("l_linestatus") == "O").alias("repair_recall"))
    return grouped.select("*", F.round(F.col("clean") - F.col("dirty"), 12).alias("damage"), F.round(F.col("repaired") - F.col("dirty"), 12).alias("recovery"),
                          (F.col("issue") == "duplicates").alias("restored_exactly"))


def status_sql(value: str, floor: float) -> str:
    agree = f"greatest(count(*) FILTER (WHERE {value} > 0), count(*) FILTER (WHERE {value} < 0)) / count(*)::DOUBLE >= 0.8"
    return f"CASE WHEN {agree} AND avg({value}) >= {floor} THEN 'positive' WHEN {agree} AND avg({value}) <= -{floor} THEN 'negative' ELSE 'weak' END"


def evidence_sql(name: str, damage: str, recovery: str, floor: float, exact: bool = True) -> str:
    ex = "restored_exactly" if exact else "false"
    p = f"count(*) FILTER (WHERE {recovery} < 0) / count(*)::DOUBLE"
    size = f"coalesce(abs(avg({recovery}) FILTER (WHERE {recovery} < 0)), 0)"
    bad = f"{recovery} < -{floor} AND NOT {ex}"
    return f"""{name} AS (SELECT issue AS error_type, rate, avg({damage}) AS mean_damage, stddev_samp({damage}) AS damage_std, avg(repair_precision) AS repair_precision, avg(repair_recall) AS repair_recall,
  avg({recovery}) AS mean_recovery, greatest(count(*) FILTER (WHERE {recovery} > 0), count(*) FILTER (WHERE {recovery} < 0)) / count(*)::DOUBLE AS sign_agreement,
  count(*) FILTER (WHERE {recovery} > 0) AS n_pos_seeds, count(*) FILTER (WHERE {recovery} < 0) AS n_neg_seeds,
  CASE WHEN bool_and({ex}) THEN CASE WHEN count(*) FILTER (WHERE {damage} > 0) / count(*)::DOUBLE >= 0.8 AND avg({damage}) >= {floor} THEN 'positive' ELSE 'weak' END ELSE {status_sql(recovery, floor)} END AS repairability_status,
  {p} AS p_harm, {size} AS harm_magnitude, {p} * {size} AS risk, CASE WHEN bool_and({ex}) THEN 0 ELSE count(*) FILTER (WHERE {bad}) / count(*)::DOUBLE END AS p_material_harm,
  CASE WHEN bool_and({ex}) THEN 0 ELSE count(*) FILTER (WHERE {bad}) / count(*)::DOUBLE * coalesce(abs(avg({recovery}) FILTER (WHERE {bad})), 0) END AS material_risk, bool_and({ex}) AS restored_exactly FROM runs GROUP BY 1, 2)"""


EV = evidence_sql("ev", "damage", "recovery", 0.003)
EV2 = evidence_sql("ev2", "damage_auc", "recovery_auc", 0.003)
STRICT = lambda a, b: f"CASE WHEN {a} = 'negative' OR {b} = 'negative' THEN 'negative' WHEN {a} = 'positive' AND {b} = 'positive' THEN 'positive' ELSE 'weak' END"


@query("damage_and_recovery", f"""WITH {RUNS_SQL} SELECT issue, rate, seed, round(damage, 6) AS damage, round(recovery, 6) AS recovery, round(CASE WHEN abs(clean - dirty) > 1e-9 THEN (repaired - dirty) / (clean - dirty) END, 4) AS recovery_rate_vs_clean,
 round(CASE WHEN abs(oracle - dirty) > 1e-9 THEN (repaired - dirty) / (oracle - dirty) END, 4) AS recovery_rate_vs_oracle FROM runs""")
def _(spark, sf):
    out = grade.with_recovery(runs(spark, sf).drop("damage", "recovery"))
    return rounded(rounded(out.select("issue", "rate", "seed", "damage", "recovery", "recovery_rate_vs_clean", "recovery_rate_vs_oracle"), 6, ["damage", "recovery"]), 4,
                   ["recovery_rate_vs_clean", "recovery_rate_vs_oracle"])


@query("run_summaries", f"""WITH {RUNS_SQL} SELECT issue, rate, round(avg(damage), 6) AS mean_damage, round(avg(recovery), 6) AS mean_recovery, round(stddev_samp(damage), 6) AS std_damage,
 round(stddev_samp(recovery), 6) AS std_recovery, count(DISTINCT seed) AS n_seeds FROM runs GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(grade.summarise_runs(runs(spark, sf), ["damage", "recovery"]), 6, ["mean_damage", "mean_recovery", "std_damage", "std_recovery"])


EV_COLUMNS = ["mean_damage", "damage_std", "repair_precision", "repair_recall", "mean_recovery", "sign_agreement", "p_harm", "harm_magnitude", "risk", "p_material_harm", "material_risk"]


@query("evidence_table", f"""WITH {RUNS_SQL}, {EV} SELECT error_type, rate, {', '.join(f'round({c}, 6) AS {c}' for c in EV_COLUMNS)}, n_pos_seeds, n_neg_seeds, repairability_status, restored_exactly,
 CASE repairability_status WHEN 'weak' THEN 'partial' ELSE 'complete' END AS evidence_status FROM ev""")
def _(spark, sf):
    return rounded(grade.evidence_table(runs(spark, sf)), 6, EV_COLUMNS)


@query("evidence_from_raw_tables", f"""WITH {RUNS_SQL}, {evidence_sql('raw', 'damage', 'recovery', 0.003, exact=False)} SELECT error_type, rate, round(mean_damage, 6) AS mean_damage, round(damage_std, 6) AS std_damage,
 round(mean_recovery, 6) AS mean_recovery, repairability_status, round(risk, 6) AS risk FROM raw""")
def _(spark, sf):
    table = runs(spark, sf)
    impact = table.groupBy(F.col("issue").alias("error_type"), "rate").agg(F.avg("damage").alias("mean_damage"), F.stddev_samp("damage").alias("std_damage"))
    out = grade.evidence_from_tables(impact, table)
    return rounded(out.select("error_type", "rate", "mean_damage", "std_damage", "mean_recovery", "repairability_status", "risk"), 6, ["mean_damage", "std_damage", "mean_recovery", "risk"])


@query("combined_evidence", f"""WITH {RUNS_SQL}, {EV}, {EV2} SELECT a.error_type, a.rate, {STRICT('a.repairability_status', 'b.repairability_status')} AS repairability_status, a.repairability_status AS status_first,
 b.repairability_status AS status_second, round(greatest(a.material_risk, b.material_risk), 6) AS material_risk, round(greatest(a.p_material_harm, b.p_material_harm), 6) AS p_material_harm,
 NOT a.restored_exactly AS underpowered FROM ev a JOIN ev2 b ON a.error_type = b.error_type AND a.rate = b.rate""")
def _(spark, sf):
    table = runs(spark, sf)
    out = grade.combine_evidence(grade.evidence_table(table), grade.evidence_table(table, 0.003, "damage_auc", "recovery_auc"), 0.003, 0.02)
    return rounded(out.select("error_type", "rate", "repairability_status", "status_first", "status_second", "material_risk", "p_material_harm", "underpowered"), 6, ["material_risk", "p_material_harm"])


RAW2 = evidence_sql("second", "damage_auc", "recovery_auc", 0.003, exact=False)
SAFE = lambda t: f"({t}.risk <= 1e-9 AND {t}.repair_precision >= 0.95 AND {t}.repairability_status <> 'negative')"


@query("second_model_evidence", f"""WITH {RUNS_SQL}, {EV}, {RAW2} SELECT b.error_type, b.rate, b.repairability_status, a.repairability_status AS first_status, a.repairability_status = b.repairability_status AS status_agrees,
 {STRICT('b.repairability_status', 'a.repairability_status')} AS effective_status, {SAFE('b')} AND {SAFE('a')} AS safe_under_both, a.repairability_status <> 'negative' AND b.repairability_status = 'negative' AS second_only_harm
 FROM second b JOIN ev a ON a.error_type = b.error_type AND a.rate = b.rate""")
def _(spark, sf):
    table = runs(spark, sf)
    other = table.drop("damage", "recovery").withColumnsRenamed({"damage_auc": "damage", "recovery_auc": "recovery"})
    out = grade.second_model_evidence(other, 0.003, grade.evidence_table(table))
    return out.select("error_type", "rate", "repairability_status", "first_status", "status_agrees", "effective_status", "safe_under_both", "second_only_harm")


@query("metric_disagreement", f"""WITH {RUNS_SQL}, c AS (SELECT issue AS error_type, rate, avg(damage) - 0.0085 AS d1, avg(damage_auc) - 0.006 AS d2 FROM runs GROUP BY 1, 2),
 g AS (SELECT error_type, count(*) FILTER (WHERE d1 <= 0 AND d2 >= 0.0001) AS h1, count(*) FILTER (WHERE d2 <= 0 AND d1 >= 0.0001) AS h2, count(*) AS n FROM c GROUP BY 1)
 SELECT error_type, true AS disagree, CASE WHEN h1 >= h2 THEN 'first metric hides damage' ELSE 'second metric hides damage' END AS note FROM g WHERE h1 * 2 > n OR h2 * 2 > n""")
def _(spark, sf):
    curve = runs(spark, sf).groupBy(F.col("issue").alias("error_type"), "rate").agg((F.avg("damage") - 0.0085).alias("mean_damage"), (F.avg("damage_auc") - 0.006).alias("mean_damage_second"))
    return grade.metric_disagreement(curve, 0.0001, 0.0001)


TRACK = lambda name, d: f"""{name} AS (SELECT error_type, count(*) AS n_points, corr(det, dmg) AS r, corr(dr, mr) AS rho, stddev_samp(det) AS ds, max(abs(dmg)) AS top, stddev_samp(dmg) AS ms FROM (SELECT *,
  rank() OVER (PARTITION BY error_type ORDER BY det) + (count(*) OVER (PARTITION BY error_type, det) - 1) / 2.0 AS dr, rank() OVER (PARTITION BY error_type ORDER BY dmg) + (count(*) OVER (PARTITION BY error_type, dmg) - 1) / 2.0 AS mr
  FROM (SELECT issue AS error_type, rate, avg(detected_rate) AS det, avg({d}) AS dmg FROM runs GROUP BY 1, 2)) GROUP BY 1)"""  # noqa: E731
BLIND = "(n_points < 3 OR ds < 1e-9 OR top < 0.003 OR ms < 1e-12)"


@query("detector_tracking", f"""WITH {RUNS_SQL}, {TRACK('t', 'damage')} SELECT error_type, n_points, round(CASE WHEN NOT {BLIND} THEN r END, 4) AS pearson_r, round(CASE WHEN NOT {BLIND} THEN rho END, 4) AS spearman_r,
 CASE WHEN {BLIND} THEN 'not_estimable' WHEN r <= -0.8 THEN 'inverted' ELSE 'weak' END AS evidence_status FROM t""")
def _(spark, sf):
    return rounded(grade.tracking_table(runs(spark, sf), 0.003), 4)


PRIO = f"""prio AS (SELECT error_type, rate, CASE WHEN max(mean_damage) OVER w - min(mean_damage) OVER w < 1e-12 THEN 0.5 ELSE (mean_damage - min(mean_damage) OVER w) / (max(mean_damage) OVER w - min(mean_damage) OVER w) END AS impact_norm,
  CASE WHEN max(risk) OVER w - min(risk) OVER w < 1e-12 THEN 0.5 ELSE (risk - min(risk) OVER w) / (max(risk) OVER w - min(risk) OVER w) END AS risk_norm,
  CASE WHEN max(mean_recovery) OVER w - min(mean_recovery) OVER w < 1e-12 THEN 0.5 ELSE (mean_recovery - min(mean_recovery) OVER w) / (max(mean_recovery) OVER w - min(mean_recovery) OVER w) END AS repairability_norm FROM ev WINDOW w AS (PARTITION BY rate))"""


@query("priorities", f"""WITH {RUNS_SQL}, {EV}, {PRIO} SELECT error_type, rate, round(impact_norm, 6) AS impact_norm, round(risk_norm, 6) AS risk_norm, round(repairability_norm, 6) AS repairability_norm,
 round(impact_norm / 3 - risk_norm / 3 + repairability_norm / 3, 6) AS priority_score FROM prio""")
def _(spark, sf):
    out = grade.priorities(grade.evidence_table(runs(spark, sf)), 1 / 3, 1 / 3, 1 / 3)
    return rounded(out.select("error_type", "rate", "impact_norm", "risk_norm", "repairability_norm", "priority_score"), 6, ["impact_norm", "risk_norm", "repairability_norm", "priority_score"])


@query("priority_sensitivity", f"""WITH {RUNS_SQL}, {EV}, {PRIO}, wv AS (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE]) AS w), combos AS (SELECT a.w AS wi, b.w AS wr, c.w AS wp FROM wv a, wv b, wv c WHERE abs(a.w + b.w + c.w - 1) < 1e-9),
 s AS (SELECT error_type, row_number() OVER (PARTITION BY wi, wr, wp ORDER BY round(wi * impact_norm - wr * risk_norm + wp * repairability_norm, 9) DESC, error_type) AS place FROM prio, combos WHERE abs(rate - 0.1) < 1e-9)
 SELECT error_type, count(*) AS n_weight_combos, round(avg(place), 6) AS mean_rank, min(place)::INT AS min_rank, max(place)::INT AS max_rank, round(avg((place = 1)::INT), 6) AS rank_1_pct, max(place) - min(place) <= 1 AS rank_stable FROM s GROUP BY 1""")
def _(spark, sf):
    return rounded(grade.sensitivity(grade.evidence_table(runs(spark, sf)), 0.1), 6)


@query("effort_priority", f"""WITH {RUNS_SQL}, i AS (SELECT issue AS error_type, avg(damage) AS mean_damage FROM runs GROUP BY 1) SELECT error_type, round(mean_damage, 6) AS mean_damage, CASE error_type WHEN 'duplicates' THEN 1.0 WHEN 'outliers' THEN 3.0
 WHEN 'missing_values' THEN 3.0 WHEN 'label_errors' THEN 8.0 ELSE 9.0 END::DOUBLE AS effort, round(mean_damage / (CASE error_type WHEN 'duplicates' THEN 1.0 WHEN 'outliers' THEN 3.0 WHEN 'missing_values' THEN 3.0 WHEN 'label_errors' THEN 8.0 ELSE 9.0 END + 1e-6), 6) AS priority FROM i""")
def _(spark, sf):
    impacts = runs(spark, sf).groupBy(F.col("issue").alias("error_type")).agg(F.avg("damage").alias("mean_damage"))
    return rounded(grade.effort_priority(impacts), 6, ["mean_damage", "priority"])


@query("readiness_verdicts", f"""WITH {RUNS_SQL}, r AS (SELECT issue, avg(clean) AS c, avg(dirty) AS d, avg(repaired) AS p FROM runs GROUP BY 1), s AS (SELECT issue, CASE WHEN c - d <= 0 THEN 1.0 ELSE (p - d) / (c - d) END AS ratio FROM r)
 SELECT issue, round(ratio, 4) AS ratio, CASE WHEN ratio >= 0.9 THEN 'ready' WHEN ratio >= 0.5 THEN 'partially ready' ELSE 'not ready' END AS verdict FROM s""")
def _(spark, sf):
    means = runs(spark, sf).groupBy("issue").agg(F.avg("clean").alias("c"), F.avg("dirty").alias("d"), F.avg("repaired").alias("p"))
    ratio, verdict = grade.readiness_ratio(F.col("c"), F.col("d"), F.col("p"))
    return means.select("issue", F.round(ratio, 4).alias("ratio"), verdict.alias("verdict"))


@query("damage_across_models", f"""WITH {RUNS_SQL}, c AS (SELECT issue AS error_type, rate, avg(damage) AS a, avg(damage_auc) AS b FROM runs GROUP BY 1, 2) SELECT error_type, rate, round(a, 6) AS first_damage, round(b, 6) AS second_damage, a >= 0.005 AS informative,
 round(CASE WHEN a >= 0.005 THEN b / a END, 4) AS ratio, max_by(error_type, a) OVER (PARTITION BY rate) AS top_first, max_by(error_type, b) OVER (PARTITION BY rate) AS top_second FROM c""")
def _(spark, sf):
    mean = lambda c: runs(spark, sf).groupBy(F.col("issue").alias("error_type"), "rate").agg(F.avg(c).alias("mean_damage"))
    out = grade.compare_damage(mean("damage_auc"), mean("damage"))
    return rounded(rounded(out, 6, ["first_damage", "second_damage"]), 4, ["ratio"])


@query("damage_rank_agreement", f"""WITH {RUNS_SQL}, c AS (SELECT avg(damage) AS a, avg(damage_auc) AS b FROM runs GROUP BY issue, rate), k AS (SELECT *, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM c)
 SELECT count(*) AS n_cells, round(corr(ra, rb), 6) AS spearman, count(*) FILTER (WHERE a >= 0.005) AS n_informative, round(quantile_cont(CASE WHEN a >= 0.005 THEN b / a END, 0.5), 4) AS median_ratio FROM k""")
def _(spark, sf):
    mean = lambda c: runs(spark, sf).groupBy(F.col("issue").alias("error_type"), "rate").agg(F.avg(c).alias("mean_damage"))
    out = grade.damage_agreement(grade.compare_damage(mean("damage_auc"), mean("damage")))
    return rounded(rounded(out, 6, ["spearman"]), 4, ["median_ratio"])


@query("kappa", """WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 'F' ELSE 'O' END AS a, l_linestatus AS b FROM lineitem), n AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS observed FROM p),
 e AS (SELECT sum(x.c * y.c)::DOUBLE AS e FROM (SELECT a, count(*) AS c FROM p GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM p GROUP BY 1) y ON x.a = y.b)
 SELECT n::BIGINT AS n, round(observed, 6) AS observed, round(e / (n * n), 6) AS chance, round((observed - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e""")
def _(spark, sf):
    frame = read(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", "F").otherwise("O").alias("a"), F.col("l_linestatus").alias("b"))
    return rounded(grade.agreement(frame, "a", "b"), 6)


@query("damage_grid", f"""WITH {RUNS_SQL} SELECT issue AS error_type, round(avg(damage) FILTER (WHERE rate = 0.05), 6) AS "0.05", round(avg(damage) FILTER (WHERE rate = 0.1), 6) AS "0.1", round(avg(damage) FILTER (WHERE rate = 0.2), 6) AS "0.2" FROM runs GROUP BY 1""")
def _(spark, sf):
    curve = runs(spark, sf).groupBy(F.col("issue").alias("error_type"), "rate").agg(F.avg("damage").alias("mean_damage"))
    return rounded(grade.damage_grid(curve), 6)


# --- policy ------------------------------------------------------------------------------------------------------
OBSERVED_SQL = """observed AS (SELECT issue AS issue_key, round(avg(detected_rate) * CASE issue WHEN 'missing_values' THEN 0.2 WHEN 'duplicates' THEN 0.225 WHEN 'outliers' THEN 0.9 WHEN 'label_errors' THEN 0.4 ELSE 0.05 END, 6) AS detected_rate FROM runs GROUP BY 1)"""


def observed(spark, sf):
    factor = (F.when(F.col("issue") == "missing_values", 0.2).when(F.col("issue") == "duplicates", 0.225).when(F.col("issue") == "outliers", 0.9)
              .when(F.col("issue") == "label_errors", 0.4).otherwise(0.05))
    return runs(spark, sf).groupBy(F.col("issue").alias("issue_key"), factor.alias("f")).agg(F.avg("detected_rate").alias("d")).select(
        "issue_key", F.round(F.col("d") * F.col("f"), 6).alias("detected_rate"))


NEAR = "near AS (SELECT * FROM (SELECT o.*, e.*, row_number() OVER (PARTITION BY issue_key ORDER BY round(abs(e.rate - o.detected_rate), 12), e.rate) AS rn FROM observed o JOIN ev e ON e.error_type = o.issue_key) WHERE rn = 1)"


@query("nearest_evidence", f"WITH {RUNS_SQL}, {EV}, {OBSERVED_SQL}, {NEAR} SELECT issue_key, detected_rate, rate, repairability_status FROM near")
def _(spark, sf):
    return policy.nearest_evidence(observed(spark, sf), grade.evidence_table(runs(spark, sf))).select("issue_key", "detected_rate", "rate", "repairability_status")


IMPACT = """curve AS (SELECT issue AS error_type, rate, avg(damage) AS d FROM runs GROUP BY 1, 2 UNION ALL SELECT DISTINCT issue, 0.0, 0.0 FROM runs), seg AS (SELECT error_type, rate AS r0, d AS d0, lead(rate) OVER w AS r1, lead(d) OVER w AS d1 FROM curve WINDOW w AS (PARTITION BY error_type ORDER BY rate)),
 est AS (SELECT issue_key, detected_rate, CASE WHEN r1 IS NULL THEN d0 ELSE d0 + (d1 - d0) * (detected_rate - r0) / (r1 - r0) END AS impact_estimate, r1 IS NULL AND detected_rate > r0 AS is_boundary_estimate FROM observed JOIN seg ON error_type = issue_key
  WHERE detected_rate >= r0 AND (r1 IS NULL OR detected_rate < r1))"""


@query("impact_estimates", f"WITH {RUNS_SQL}, {OBSERVED_SQL}, {IMPACT} SELECT issue_key, detected_rate, round(impact_estimate, 6) AS impact_estimate, is_boundary_estimate FROM est")
def _(spark, sf):
    curve = runs(spark, sf).groupBy(F.col("issue").alias("error_type"), "rate").agg(F.avg("damage").alias("mean_damage"))
    return rounded(policy.impact_estimates(observed(spark, sf), curve), 6)


def _policy(spark, sf):
    seen = observed(spark, sf).select("issue_key", F.lit(True).alias("detector_ran"), "detected_rate", F.lit(5).cast("long").alias("n_repair_candidates"), F.lit(2).cast("long").alias("n_flag_only"))
    evidence = policy.with_source_priority(grade.evidence_table(runs(spark, sf)), None)
    return policy.build_policy(seen, evidence)


POLICY = f"""{RUNS_SQL}, {EV}, {OBSERVED_SQL}, {NEAR}, pol AS (SELECT issue_key, detected_rate, repairability_status, material_risk AS benchmark_risk, repair_precision, material_risk <= 1e-9 AND repair_precision >= 0.95 AND repairability_status <> 'negative'
  AND issue_key NOT IN ('label_errors', 'feature_corruption') AS safe_auto FROM near)"""


@query("repair_policy", f"""WITH {POLICY} SELECT issue_key, detected_rate, repairability_status, round(benchmark_risk, 6) AS benchmark_risk, round(repair_precision, 6) AS benchmark_repair_precision, safe_auto,
 CASE WHEN safe_auto THEN 'auto-repair' ELSE 'flag for human review' END AS default_action FROM pol""")
def _(spark, sf):
    out = _policy(spark, sf).select("issue_key", "detected_rate", "repairability_status", "benchmark_risk", "benchmark_repair_precision", "safe_auto", "default_action")
    return rounded(out, 6)


@query("safe_decisions", f"WITH {RUNS_SQL}, {EV} SELECT error_type, rate, risk <= 1e-9 AND repair_precision >= 0.95 AND repairability_status <> 'negative' AS safe_auto FROM ev")
def _(spark, sf):
    return policy.safe_auto(grade.evidence_table(runs(spark, sf))).select("error_type", "rate", "safe_auto")


@query("evidence_source_priority", f"""WITH {RUNS_SQL}, {EV}, {EV2} SELECT error_type, rate, repairability_status, 'own' AS source FROM ev WHERE error_type IN ('outliers', 'duplicates') UNION ALL
 SELECT error_type, rate, repairability_status, 'published' FROM ev2 WHERE error_type NOT IN ('outliers', 'duplicates')""")
def _(spark, sf):
    table = runs(spark, sf)
    own = grade.evidence_table(table).filter(F.col("error_type").isin("outliers", "duplicates"))
    out = policy.with_source_priority(own, grade.evidence_table(table, 0.003, "damage_auc", "recovery_auc"))
    return out.select("error_type", "rate", "repairability_status", "source")


@query("second_model_check", f"""WITH {RUNS_SQL}, {EV}, {EV2} SELECT a.error_type, a.rate, CASE WHEN a.repairability_status = b.repairability_status THEN 'agree' ELSE 'model-dependent' END AS model_check,
 {STRICT('a.repairability_status', 'b.repairability_status')} AS repairability_status, round(greatest(a.risk, b.risk), 6) AS risk FROM ev a JOIN ev2 b ON a.error_type = b.error_type AND a.rate = b.rate""")
def _(spark, sf):
    table = runs(spark, sf)
    out = policy.second_model_check(policy.with_source_priority(None, grade.evidence_table(table)), grade.evidence_table(table, 0.003, "damage_auc", "recovery_auc"))
    return rounded(out.select("error_type", "rate", "model_check", "repairability_status", "risk"), 6, ["risk"])


@query("impact_report", f"""WITH {POLICY}, {IMPACT} SELECT p.issue_key, p.detected_rate, round(impact_estimate, 6) AS impact_estimate, is_boundary_estimate, CASE WHEN p.issue_key = 'outliers' THEN CASE WHEN safe_auto THEN 'applied' ELSE 'applied (human override)' END
 ELSE 'flagged for human review (not applied)' END AS policy_decision FROM pol p JOIN est e ON e.issue_key = p.issue_key""")
def _(spark, sf):
    curve = runs(spark, sf).groupBy(F.col("issue").alias("error_type"), "rate").agg(F.avg("damage").alias("mean_damage"))
    out = policy.impact_report(_policy(spark, sf), policy.impact_estimates(observed(spark, sf), curve), None, None, {"outliers"})
    return rounded(out.select("issue_key", "detected_rate", "impact_estimate", "is_boundary_estimate", "policy_decision"), 6)


@query("readiness_report", f"""WITH {RUNS_SQL}, {OBSERVED_SQL}, {TRACK('t', 'damage')}, f AS (SELECT issue AS issue_key, min(detected_rate) * 0.25 AS floor FROM runs GROUP BY 1), s AS (SELECT o.issue_key, detected_rate, CASE WHEN o.issue_key IN ('missing_values', 'duplicates') THEN 0.0 ELSE floor END AS floor,
 CASE WHEN {BLIND} THEN 'not_estimable' WHEN r <= -0.8 THEN 'inverted' ELSE 'weak' END AS st FROM observed o JOIN t ON t.error_type = o.issue_key JOIN f ON f.issue_key = o.issue_key)
 SELECT issue_key, detected_rate AS observed_rate, round(floor, 6) AS baseline_false_positive_floor, st AS evidence_status, CASE WHEN st = 'inverted' THEN 'High uncertainty' WHEN st = 'not_estimable' THEN 'Evidence-limited' WHEN detected_rate > floor * 1.5 + 0.02 THEN 'Attention' ELSE 'Good' END AS status FROM s""")
def _(spark, sf):
    seen = observed(spark, sf).select("issue_key", F.lit(True).alias("detector_ran"), "detected_rate", F.lit(1).cast("long").alias("detected_count"))
    statuses = policy.evidence_status(seen, grade.tracking_table(runs(spark, sf), 0.003), {})
    floors = runs(spark, sf).groupBy(F.col("issue").alias("issue_key")).agg((F.min("detected_rate") * 0.25).alias("floor"))
    out = policy.readiness_report(policy.quality_report(seen, None, statuses), floors)
    return rounded(out.select("issue_key", "observed_rate", "baseline_false_positive_floor", "evidence_status", "status"), 6)


@query("quality_dimensions", f"""WITH {RUNS_SQL}, {OBSERVED_SQL} SELECT issue_key, CASE issue_key WHEN 'missing_values' THEN 'Completeness' WHEN 'duplicates' THEN 'Uniqueness' WHEN 'outliers' THEN 'Anomaly burden' WHEN 'label_errors' THEN 'Label reliability' ELSE 'Feature reliability' END AS dimension,
 round(CASE WHEN issue_key = 'outliers' THEN detected_rate ELSE 1 - detected_rate END, 6) AS score FROM observed""")
def _(spark, sf):
    return rounded(policy.quality_dimensions(observed(spark, sf)), 6)


@query("quality_with_reliability", f"""WITH {RUNS_SQL}, {OBSERVED_SQL}, rel AS (SELECT issue AS issue_key, avg(repair_precision) AS p, avg(repair_recall) AS r FROM runs WHERE issue <> 'label_errors' GROUP BY 1)
 SELECT o.issue_key, detected_rate, round(p, 6) AS benchmark_precision, round(r, 6) AS benchmark_recall FROM observed o LEFT JOIN rel USING (issue_key)""")
def _(spark, sf):
    seen = observed(spark, sf).select("issue_key", F.lit(True).alias("detector_ran"), "detected_rate", F.lit(1).cast("long").alias("detected_count"))
    scores = runs(spark, sf).filter("issue <> 'label_errors'").groupBy(F.col("issue").alias("error_type")).agg(F.avg("repair_precision").alias("precision"), F.avg("repair_recall").alias("recall"))
    return rounded(policy.quality_report(seen, scores).select("issue_key", "detected_rate", "benchmark_precision", "benchmark_recall"), 6)
