"""Registered queries: splits, metrics, model-based detectors, relevance, calibration and model comparison."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from sievestone.catalog import sqltext as q
from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import SALES_SQL, read, sales
from sievestone.operators import features, inject, joint, labels, models, relevance, sampling
from sievestone.operators.models import Task
from sievestone.operators.prepare import prepare
from sievestone.plans import compare
from sievestone.plans.audit import audit
from sievestone.plans.calibrate import clean_reference, run_calibration, same_rows
from sievestone.plans.fits import Fit, fit_all
from sievestone.session import cut_lineage

QUERIES, SQL, query = registry()
NUMBERS, TEXTS = ["items", "quantity", "discount", "balance"], ["priority", "segment"]

BASKETS_SQL = """baskets AS (SELECT o_orderkey AS row_id, count(*)::DOUBLE AS items, sum(l_quantity) AS quantity, max(l_discount) AS discount, any_value(c_acctbal) AS balance, any_value(o_orderpriority) AS priority,
 any_value(c_mktsegment) AS segment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, CASE WHEN sum(l_extendedprice * (1 - l_discount)) > 180000 THEN 'big' ELSE 'small' END AS size
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


def baskets(spark, sf):
    """One row per order with line items: four numbers, two texts, a class and a numeric target."""
    net = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderkey").alias("row_id"))
            .agg(F.count(F.lit(1)).cast("double").alias("items"), F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"),
                 F.max("c_acctbal").alias("balance"), F.max("o_orderpriority").alias("priority"), F.max("c_mktsegment").alias("segment"),
                 F.round(net, 2).alias("net"), F.when(net > 180000, "big").otherwise("small").alias("size")))


def stored(spark, sf):
    return cut_lineage(baskets(spark, sf))


CLASSES = Task("row_id", "size", NUMBERS, TEXTS)
AMOUNTS = Task("row_id", "net", NUMBERS, TEXTS, regression=True)


def labelled(spark, sf):
    return stored(spark, sf).drop("net")


def amounts(spark, sf):
    return stored(spark, sf).drop("size")


# --- splits ------------------------------------------------------------------------------------------------------
RANKED = f"ranked AS (SELECT row_id, status, row_number() OVER (PARTITION BY status ORDER BY {q.md5_of(4, 'row_id')}) AS rn, count(*) OVER (PARTITION BY status) AS n FROM sales)"


@query("three_way_split", f"""WITH {SALES_SQL}, {RANKED} SELECT row_id, (rn > floor(n * 0.7::DOUBLE + 1e-9))::INT + (rn > floor(n * 0.85::DOUBLE + 1e-9))::INT AS part FROM ranked""")
def _(spark, sf):
    return sampling.split(sales(spark, sf), "row_id", "status", [0.7, 0.15, 0.15], 4).select("row_id", "part")


@query("stratified_folds", f"WITH {SALES_SQL}, {RANKED} SELECT row_id, (rn > floor(n * 0.2::DOUBLE + 1e-9))::INT + (rn > floor(n * 0.4::DOUBLE + 1e-9))::INT + (rn > floor(n * 0.6::DOUBLE + 1e-9))::INT + (rn > floor(n * 0.8::DOUBLE + 1e-9))::INT AS fold FROM ranked")
def _(spark, sf):
    return sampling.folds(sales(spark, sf), "row_id", "status", 5, 4).select("row_id", "fold")


@query("stratified_sample", f"WITH {SALES_SQL}, {RANKED} SELECT row_id, status FROM ranked WHERE rn <= greatest(5, round_even(n * 3000 / (SELECT count(*) FROM sales)::DOUBLE, 0))")
def _(spark, sf):
    return sampling.stratified_sample(sales(spark, sf), "row_id", "status", 3000, 4).select("row_id", "status")


@query("random_sample", f"SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY {q.md5_of(8, 'event_id')}) <= 500")
def _(spark, sf):
    return sampling.sample_rows(read(spark, sf, "events"), "event_id", 500, 8).select("event_id")


@query("quantile_strata", """WITH e AS (SELECT quantile_cont(o_totalprice, 0.2) AS a, quantile_cont(o_totalprice, 0.4) AS b, quantile_cont(o_totalprice, 0.6) AS c, quantile_cont(o_totalprice, 0.8) AS d FROM orders)
 SELECT o_orderkey, CAST((o_totalprice > a)::INT + (o_totalprice > b)::INT + (o_totalprice > c)::INT + (o_totalprice > d)::INT AS VARCHAR) AS stratum FROM orders, e""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    return orders.select("o_orderkey", sampling.quantile_strata(orders, "o_totalprice").alias("stratum"))


@query("train_test_leakage", """WITH t AS (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 4 <> 0) SELECT p_partkey FROM part p WHERE p_partkey % 4 = 0 AND EXISTS (SELECT 1 FROM t WHERE t.p_brand = p.p_brand AND t.p_type = p.p_type AND t.p_size = p.p_size)""")
def _(spark, sf):
    part = read(spark, sf, "part")
    return compare.leaked_rows(part.filter("p_partkey % 4 <> 0"), part.filter("p_partkey % 4 = 0"), ["p_brand", "p_type", "p_size"]).select("p_partkey")


@query("exact_restoration", "SELECT 'restored' AS version, true AS same_rows UNION ALL SELECT 'dirty', false")
def _(spark, sf):
    clean = sales(spark, sf)
    step = inject.inject_duplicates(clean, "row_id", 0.05, 13)
    from sievestone.operators.apply import oracle_repair

    back = oracle_repair(step.frame, "row_id", step.log, ["price"])
    return spark.createDataFrame([("restored", same_rows(back, clean)), ("dirty", same_rows(step.frame, clean))], "version string, same_rows boolean")


# --- metrics on a rule's predictions -----------------------------------------------------------------------------
RULE_SQL = f"""{BASKETS_SQL}, scored AS (SELECT row_id, size AS label, CASE WHEN quantity > 100 THEN 'big' ELSE 'small' END AS prediction, quantity / 400 AS score, net, 1500 * quantity AS guess FROM baskets)"""


def by_rule(spark, sf):
    return baskets(spark, sf).select("row_id", F.col("size").alias("label"), F.when(F.col("quantity") > 100, "big").otherwise("small").alias("prediction"),
                                     (F.col("quantity") / 400).alias("score"), "net", (1500 * F.col("quantity")).alias("guess"))


@query("confusion_matrix", f"WITH {RULE_SQL} SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2")
def _(spark, sf):
    return models.confusion(by_rule(spark, sf))


CLASS_SQL = f"""WITH {RULE_SQL}, c AS (SELECT unnest(['big', 'small']) AS cls), r AS (SELECT cls, count(*) FILTER (WHERE label = cls) AS support, count(*) FILTER (WHERE prediction = cls) AS given, count(*) FILTER (WHERE label = cls AND prediction = cls) AS tp, count(*) AS total FROM c, scored GROUP BY 1)"""


@query("class_report", CLASS_SQL + """ SELECT cls, support, round(tp / given::DOUBLE, 6) AS precision, round(tp / support::DOUBLE, 6) AS recall, round(2.0 * tp / (support + given), 6) AS f1, round((total - support - given + tp) / (total - support)::DOUBLE, 6) AS specificity FROM r""")
def _(spark, sf):
    return rounded(models.class_report(by_rule(spark, sf)), 6)


@query("summary_scores", CLASS_SQL + " SELECT round(sum(tp) / max(total)::DOUBLE, 6) AS accuracy, round(avg(2.0 * tp / (support + given)), 6) AS macro_f1, round(avg(tp / support::DOUBLE), 6) AS balanced_accuracy FROM r")
def _(spark, sf):
    return rounded(models.summary_scores(by_rule(spark, sf)), 6)


@query("roc_auc_by_ranks", f"""WITH {RULE_SQL}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored), s AS (SELECT sum(r) FILTER (WHERE label = 'big')::DOUBLE AS sr, count(*) FILTER (WHERE label = 'big')::DOUBLE AS p, count(*) FILTER (WHERE label <> 'big')::DOUBLE AS n FROM k)
 SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""")
def _(spark, sf):
    value = models.auc(by_rule(spark, sf), F.col("label") == "big", F.col("score"))
    return spark.createDataFrame([(round(value, 6),)], "auc double")


@query("threshold_sweep", f"""WITH {RULE_SQL}, t AS (SELECT unnest(range(1, 20)) AS i), r AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold, count(*) FILTER (WHERE label = 'big' AND score >= round(0.05 * i, 2)::DOUBLE) AS tp, count(*) FILTER (WHERE score >= round(0.05 * i, 2)::DOUBLE) AS given, count(*) FILTER (WHERE label = 'big') AS pos, count(*) AS total FROM t, scored GROUP BY 1)
 SELECT threshold, round(CASE WHEN given > 0 THEN tp / given::DOUBLE ELSE 0 END, 6) AS precision, round(tp / pos::DOUBLE, 6) AS recall, round(2.0 * tp / (given + pos), 6) AS f1, round((total - pos - given + 2 * tp) / total::DOUBLE, 6) AS accuracy FROM r""")
def _(spark, sf):
    return rounded(models.threshold_sweep(by_rule(spark, sf), F.col("label") == "big", F.col("score")), 6)


@query("regression_metrics", f"""WITH {RULE_SQL} SELECT round(1 - sum((net - guess) * (net - guess)) / (var_pop(net) * count(*)), 6) AS r2, round(sqrt(avg((net - guess) * (net - guess))), 2) AS rmse, round(avg(abs(net - guess)), 2) AS mae, round(stddev_pop(net), 2) AS mean_rmse FROM scored""")
def _(spark, sf):
    out = models.regression_scores(by_rule(spark, sf), "net", "guess")
    return rounded(rounded(out, 6, ["r2"]), 2, ["rmse", "mae", "mean_rmse"])


@query("out_of_range_share", f"WITH {BASKETS_SQL}, f AS (SELECT regr_slope((size = 'big')::INT, quantity) AS b, regr_intercept((size = 'big')::INT, quantity) AS a FROM baskets) SELECT round(avg((a + b * quantity < 0 OR a + b * quantity > 1)::INT), 6) AS share_outside FROM baskets, f")
def _(spark, sf):
    frame = baskets(spark, sf).withColumn("y", (F.col("size") == "big").cast("double"))
    fit = frame.agg(F.regr_slope("y", "quantity").alias("b"), F.regr_intercept("y", "quantity").alias("a")).first()
    p = F.lit(fit["a"]) + F.lit(fit["b"]) * F.col("quantity")
    return frame.agg(F.round(F.avg(((p < 0) | (p > 1)).cast("double")), 6).alias("share_outside"))


@query("simple_regression", f"WITH {BASKETS_SQL} SELECT round(regr_slope(net, quantity), 4) AS slope, round(regr_intercept(net, quantity), 2) AS intercept, round(regr_r2(net, quantity), 6) AS r2, round(regr_slope(net, quantity) * stddev_samp(quantity) / stddev_samp(net), 6) AS standardised FROM baskets")
def _(spark, sf):
    slope = F.regr_slope("net", "quantity")
    return baskets(spark, sf).agg(F.round(slope, 4).alias("slope"), F.round(F.regr_intercept("net", "quantity"), 2).alias("intercept"), F.round(F.regr_r2("net", "quantity"), 6).alias("r2"),
                                  F.round(slope * F.stddev_samp("quantity") / F.stddev_samp("net"), 6).alias("standardised"))


@query("least_squares_inference", f"""WITH {BASKETS_SQL}, m AS (SELECT count(*)::DOUBLE AS n, avg(quantity) AS mx, avg(discount) AS mz, avg(net) AS my, var_pop(quantity) AS vx, var_pop(discount) AS vz, covar_pop(quantity, discount) AS cxz, covar_pop(quantity, net) AS cxy, covar_pop(discount, net) AS czy, var_pop(net) AS vy FROM baskets),
 b AS (SELECT *, (cxy * vz - czy * cxz) / (vx * vz - cxz * cxz) AS b1, (czy * vx - cxy * cxz) / (vx * vz - cxz * cxz) AS b2 FROM m), r AS (SELECT *, (vy - b1 * cxy - b2 * czy) * n / (n - 3) AS s2 FROM b)
 SELECT 'quantity' AS term, round(b1, 3) AS coef, round(sqrt(s2 * vz / (n * (vx * vz - cxz * cxz))), 3) AS se, round(b1 / sqrt(s2 * vz / (n * (vx * vz - cxz * cxz))), 2) AS t FROM r UNION ALL
 SELECT 'discount', round(b2, 3), round(sqrt(s2 * vx / (n * (vx * vz - cxz * cxz))), 3), round(b2 / sqrt(s2 * vx / (n * (vx * vz - cxz * cxz))), 2) FROM r""")
def _(spark, sf):
    fit = models.least_squares(baskets(spark, sf), "net", ["quantity", "discount"])
    rows = [(name, round(c, 3), round(s, 3), round(t, 2)) for name, c, s, t in zip(fit["names"], fit["coef"], fit["se"], fit["t"]) if name != "intercept"]
    return spark.createDataFrame(rows, "term string, coef double, se double, t double")


@query("variance_inflation", f"WITH {BASKETS_SQL}, r AS (SELECT 1 / (1 - corr(quantity, items) * corr(quantity, items)) AS v FROM baskets) SELECT 'quantity' AS term, round(v, 4) AS vif FROM r UNION ALL SELECT 'items', round(v, 4) FROM r")
def _(spark, sf):
    found = models.variance_inflation(baskets(spark, sf), ["quantity", "items"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in found.items()], "term string, vif double")


@query("nested_regressions")
def _(spark, sf):
    frame, rows = baskets(spark, sf), []
    for i in range(1, len(NUMBERS) + 1):
        fit = models.least_squares(frame, "net", NUMBERS[:i])
        rows.append((", ".join(NUMBERS[:i]), fit["r2"], fit["adj_r2"], fit["f"], fit["residual_std"]))
    return spark.createDataFrame(rows, "predictors string, r2 double, adj_r2 double, f double, residual_std double")


# --- relevance ---------------------------------------------------------------------------------------------------
@query("column_uniqueness", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS levels, count({c}) AS filled, round(count(DISTINCT {c}) / count({c})::DOUBLE, 6) AS ratio, round((SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {c})) / count({c})::DOUBLE, 6) AS top_share FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def _(spark, sf):
    return rounded(relevance.column_uniqueness(read(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), 6)


@query("monotonic_columns", """WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey * 2 AS twice, lag(o_custkey) OVER (ORDER BY o_orderkey) AS pc, lag(o_orderkey * 2) OVER (ORDER BY o_orderkey) AS pt FROM orders)
 SELECT 'o_custkey' AS "column", bool_and(coalesce(o_custkey >= pc, true)) OR bool_and(coalesce(o_custkey <= pc, true)) AS monotonic FROM t UNION ALL SELECT 'twice', bool_and(coalesce(twice >= pt, true)) FROM t""")
def _(spark, sf):
    frame = read(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 2).alias("twice"))
    found = relevance.monotonic_columns(frame, "o_orderkey", ["o_custkey", "twice"])
    return spark.createDataFrame([(c, c in found) for c in ("o_custkey", "twice")], "column string, monotonic boolean")


@query("one_to_one_columns", """SELECT 'c_nationkey' AS a, 'n_name' AS b, count(*) AS rows, (SELECT max(k) FROM (SELECT count(DISTINCT n_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey)) AS max_per_x,
 (SELECT max(k) FROM (SELECT count(DISTINCT c_nationkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)) AS max_per_y FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
 SELECT 'c_nationkey', 'n_regionkey', count(*), 1, (SELECT max(k) FROM (SELECT count(DISTINCT c_nationkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)) FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    joined = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return relevance.pair_mappings(joined, [("c_nationkey", "n_name"), ("c_nationkey", "n_regionkey")])


@query("structural_flags", """SELECT unnest(['x_constant', 'x_copy', 'x_linear', 'n_name', 'row_number', 'label_text']) AS "column", unnest(['constant', 'redundant', 'redundant', 'redundant', 'id_like', 'id_like']) AS verdict""")
def _(spark, sf):
    joined = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    frame = joined.select(F.col("c_custkey").alias("row_id"), "c_acctbal", F.lit("same").alias("x_constant"), F.col("c_acctbal").alias("x_copy"), (F.col("c_acctbal") * 0.5 + 3).alias("x_linear"),
                          F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation_code"), "n_name", (F.col("c_custkey") * 3).alias("row_number"), F.col("c_name").alias("label_text"))
    p = prepare(frame, "row_id")
    flags = relevance.structural_flags(p.frame, "row_id", p.numbers, p.texts, p.integer_like)
    return spark.createDataFrame([(c, v) for c, (v, _) in flags.items()], "column string, verdict string")


@query("mutual_information", """WITH u AS (SELECT 'l_returnflag' AS "column", l_returnflag AS v, l_linestatus AS y FROM lineitem UNION ALL SELECT 'tax_bin', CAST((l_tax > 0.02)::INT + (l_tax > 0.05)::INT AS VARCHAR), l_linestatus FROM lineitem),
 p AS (SELECT "column", v, y, count(*)::DOUBLE AS n FROM u GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY "column", v) AS nx, sum(n) OVER (PARTITION BY "column", y) AS ny, sum(n) OVER (PARTITION BY "column") AS total FROM p)
 SELECT "column", round(sum(n / total * ln(n * total / (nx * ny))) * 1000, 6) AS mi_per_thousand FROM t GROUP BY 1""")
def _(spark, sf):
    bins = ((F.col("l_tax") > 0.02).cast("int") + (F.col("l_tax") > 0.05).cast("int")).cast("string")
    frame = read(spark, sf, "lineitem").withColumn("tax_bin", bins)
    out = relevance.mutual_information(frame, [], ["l_returnflag", "tax_bin"], F.col("l_linestatus"))
    return out.select("column", F.round(F.col("mi") * 1000, 6).alias("mi_per_thousand"))


@query("anova_and_variance", f"""WITH {BASKETS_SQL}, """ + ", ".join(f"g_{c} AS (SELECT size, count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v FROM baskets GROUP BY 1)" for c in ("quantity", "balance")) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round((sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2)) / (sum(n * v) / (sum(n) - 2)), 3) AS anova_f, round((sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2) + sum(n * v)) / sum(n), 1) AS variance FROM g_{c}""" for c in ("quantity", "balance")))
def _(spark, sf):
    out = relevance.selection_scores(baskets(spark, sf), ["quantity", "balance"], F.col("size"))
    return rounded(rounded(out, 3, ["anova_f"]), 1, ["variance"])


@query("target_correlation", f"""WITH {BASKETS_SQL} SELECT 'quantity' AS "column", round(corr(quantity, (size = 'big')::INT), 6) AS pearson FROM baskets UNION ALL SELECT 'balance', round(corr(balance, (size = 'big')::INT), 6) FROM baskets""")
def _(spark, sf):
    hit = (F.col("size") == "big").cast("double")
    wide = baskets(spark, sf).agg(F.corr("quantity", hit).alias("a"), F.corr("balance", hit).alias("b"))
    return wide.select(F.explode(F.array(F.struct(F.lit("quantity").alias("column"), F.round("a", 6).alias("pearson")), F.struct(F.lit("balance").alias("column"), F.round("b", 6).alias("pearson")))).alias("r")).select("r.*")


@query("random_probe_columns")
def _(spark, sf):
    probed, numbers, texts = relevance.add_probes(baskets(spark, sf), "row_id", 42)
    return probed.select("row_id", *numbers, *texts)


@query("permutation_importance")
def _(spark, sf):
    parts = cut_lineage(sampling.split(labelled(spark, sf), "row_id", "size", [0.7, 0.3], 1))
    return relevance.permutation_importance(CLASSES, parts.filter("part = 0"), parts.filter("part = 1"))


@query("assess_feature_relevance")
def _(spark, sf):
    return relevance.assess_features(prepare(labelled(spark, sf), "row_id", "size"))


@query("embedded_selection")
def _(spark, sf):
    frame = labelled(spark, sf)
    ready = models.fit_encoder(frame, NUMBERS, []).transform(frame.withColumn("_y", models.class_code("size", ["big", "small"])))
    lasso = LogisticRegression(labelCol="_y", regParam=0.01, elasticNetParam=1.0).fit(ready)
    forest = models.classifier("random_forest", 2, 0).fit(ready)
    rows = [(c, float(a), float(b)) for c, a, b in zip(NUMBERS, lasso.coefficients.toArray(), forest.featureImportances.toArray())]
    return spark.createDataFrame(rows, "column string, l1_coefficient double, forest_importance double")


# --- model-based detectors ---------------------------------------------------------------------------------------
@query("detect_label_errors")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_labels(labelled(spark, sf), "row_id", "size", 0.05, 3).frame)
    return labels.noisy_labels(labels.label_scores(hurt, "row_id", "size", NUMBERS, TEXTS))


@query("noisy_label_filter")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_labels(labelled(spark, sf), "row_id", "size", 0.05, 3).frame)
    scored = cut_lineage(labels.label_scores(hurt, "row_id", "size", NUMBERS, TEXTS))
    return labels.keep_trusted(hurt, "row_id", scored, 0.2).groupBy("size").agg(F.count(F.lit(1)).alias("kept"))


@query("detect_target_errors")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_target_shift(amounts(spark, sf), "row_id", "net", 0.03, 3).frame)
    return labels.target_scores(hurt, "row_id", "net", NUMBERS, TEXTS).filter(F.col("z") > labels.TARGET_Z)


@query("detect_feature_anomalies")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_swaps(amounts(spark, sf), "row_id", ["quantity", "net"], 0.03, 3).frame)
    return features.suspicious_cells(features.cross_feature_scores(hurt, "row_id", ["quantity", "net"], ["segment"]))


@query("pca_reconstruction_outliers")
def _(spark, sf):
    return features.pca_errors(amounts(spark, sf), "row_id", NUMBERS + ["net"], TEXTS).filter("flagged")


@query("pca_explained_variance")
def _(spark, sf):
    return features.pca_variance(amounts(spark, sf), NUMBERS + ["net"])


@query("detect_joint_outliers")
def _(spark, sf):
    frame = amounts(spark, sf)
    hurt = cut_lineage(inject.inject_joint(frame, "row_id", ["quantity", "net"], 0.02, 3).frame)
    return joint.joint_outliers(hurt, "row_id", ["quantity", "net", "balance"], {"quantity"}).records


@query("joint_eligible_columns")
def _(spark, sf):
    ok, skipped = joint.eligible_columns(amounts(spark, sf), "row_id", NUMBERS + ["net"], {"items", "quantity"})
    return spark.createDataFrame([(c, True, "") for c in ok] + [(c, False, why) for c, why in skipped.items()], "column string, eligible boolean, reason string")


@query("normal_scores", """WITH b AS (SELECT l_quantity AS value, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), r AS (SELECT value, sum(n) OVER (ORDER BY value) - n AS below, n, sum(n) OVER () AS total FROM b) SELECT value, round((below + n / 2) / total, 9) AS p FROM r""")
def _(spark, sf):
    from sievestone.operators.ranks import value_ranks

    ranks = value_ranks(read(spark, sf, "lineitem"), F.col("l_quantity"))
    total = read(spark, sf, "lineitem").count()
    return ranks.select("value", F.round((F.col("below") + F.col("n") / 2) / F.lit(float(total)), 9).alias("p"))


@query("joint_grading")
def _(spark, sf):
    step = inject.inject_joint(amounts(spark, sf), "row_id", ["quantity", "net"], 0.02, 3)
    log = cut_lineage(step.log)
    found = joint.joint_outliers(cut_lineage(step.frame), "row_id", ["quantity", "net", "balance"], {"quantity"}).records
    hit = found.select("row_id").distinct().withColumn("found", F.lit(True))
    worst = found.select("row_id", F.col("column").alias("blamed"))
    rows = log.groupBy("row_id", "kind", "invisible").agg(F.collect_set("column").alias("changed"))
    joined = rows.join(hit, "row_id", "left").join(worst.groupBy("row_id").agg(F.min("blamed").alias("blamed")), "row_id", "left")
    return joined.groupBy("kind", "invisible").agg(F.count(F.lit(1)).alias("rows"), F.count("found").alias("found"),
                                                   F.count_if(F.array_contains("changed", F.col("blamed"))).alias("rightly_attributed"))


@query("full_audit_with_target")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_all(labelled(spark, sf), "row_id", NUMBERS + TEXTS, "size", 0.03, 3).frame)
    return audit(hurt, "row_id", "size").policy


# --- models ------------------------------------------------------------------------------------------------------
def parts(frame, stratum="size"):
    split = cut_lineage(sampling.split(frame, "row_id", stratum, [0.7, 0.3], 1))
    return split.filter("part = 0").drop("part"), split.filter("part = 1").drop("part")


@query("baseline_models")
def _(spark, sf):
    train, test = parts(labelled(spark, sf))
    fits = [Fit("all", kind, 0) for kind in models.CLASSIFIERS]
    got = fit_all(CLASSES, {"all": train}, test, fits)
    rows = [(f.model, got[f]["score"], got[f]["accuracy"], got[f]["auc"]) for f in fits]
    return spark.createDataFrame(rows, "model string, macro_f1 double, accuracy double, auc double")


@query("cross_validated_scores")
def _(spark, sf):
    return compare.cross_validated(labelled(spark, sf), CLASSES, "logistic", 3)


@query("scaling_comparison")
def _(spark, sf):
    train, test = parts(labelled(spark, sf))
    rows = []
    for scale in (False, True):
        encoder = models.fit_encoder(train, NUMBERS, TEXTS, scale)
        code = lambda frame: encoder.transform(frame.withColumn("_y", models.class_code("size", ["big", "small"])))  # noqa: E731, B023
        model = LogisticRegression(labelCol="_y", maxIter=20, standardization=False).fit(code(train))
        rows.append((scale, model.evaluate(code(test)).accuracy))
    return spark.createDataFrame(rows, "standardised boolean, accuracy double")


@query("tree_depth_sweep")
def _(spark, sf):
    train, test = parts(labelled(spark, sf))
    encoder = models.fit_encoder(train, NUMBERS, TEXTS)
    code = lambda frame: encoder.transform(frame.withColumn("_y", models.class_code("size", ["big", "small"]))).persist()
    a, b = code(train), code(test)
    rows = []
    for depth in (1, 2, 4, 8):
        model = models.classifier("tree", 2, 0).setMaxDepth(depth).fit(a)
        hit = F.avg((F.col("_y") == F.col("prediction")).cast("double"))
        rows.append((depth, model.transform(a).agg(hit).first()[0], model.transform(b).agg(hit).first()[0]))
    return spark.createDataFrame(rows, "depth int, train_accuracy double, validation_accuracy double")


@query("odds_ratios")
def _(spark, sf):
    frame = labelled(spark, sf)
    ready = models.fit_encoder(frame, NUMBERS, []).transform(frame.withColumn("_y", models.class_code("size", ["small", "big"])))
    fit = LogisticRegression(labelCol="_y").fit(ready)
    coefficients = spark.createDataFrame([(c, float(v)) for c, v in zip(NUMBERS, fit.coefficients.toArray())], "column string, coefficient double")
    filled = frame.agg(*[F.count(c).alias(c) for c in NUMBERS])
    support = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in NUMBERS])).alias("r")).select("r.*")
    return coefficients.join(support, "column").withColumn("odds_ratio", F.exp("coefficient"))


@query("configuration_selection")
def _(spark, sf):
    train, test = parts(labelled(spark, sf))
    rows = [(t, models.evaluate(CLASSES, "random_forest", train, test, 0, t, with_auc=False)["score"]) for t in (4, 8, 16)]
    table = spark.createDataFrame(rows, "trees int, score double")
    best = table.agg(F.max_by(F.struct("trees"), F.struct(F.round("score", 6), -F.col("trees")))["trees"].alias("best"))
    return table.join(F.broadcast(best)).withColumn("chosen", F.col("trees") == F.col("best")).drop("best")


# --- jobs --------------------------------------------------------------------------------------------------------
@query("clean_reference_set")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_missing(labelled(spark, sf), "row_id", NUMBERS + TEXTS, 0.02, 3).frame)
    state = audit(hurt, "row_id", "size", detectors={"missing_values"})
    ref, _ = clean_reference(state)
    return ref.groupBy("size").agg(F.count(F.lit(1)).alias("rows"))


@query("calibration_evidence")
def _(spark, sf):
    state = audit(labelled(spark, sf), "row_id", "size", detectors={"missing_values"})
    out = run_calibration(state)
    return out.evidence


@query("regression_calibration_runs")
def _(spark, sf):
    state = audit(amounts(spark, sf), "row_id", "net", task="regression", detectors={"missing_values"})
    out = run_calibration(state)
    return out.runs


@query("model_panel")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_outliers(labelled(spark, sf), "row_id", NUMBERS, 0.1, 3).frame)
    return compare.run_panel(hurt, CLASSES)


@query("arm_interaction")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_outliers(labelled(spark, sf), "row_id", NUMBERS, 0.1, 3).frame)
    return compare.arm_interaction(compare.run_panel(hurt, CLASSES))


@query("regression_panel")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_outliers(amounts(spark, sf), "row_id", NUMBERS, 0.1, 3).frame)
    return compare.run_panel(hurt, AMOUNTS)


@query("controlled_proof")
def _(spark, sf):
    return compare.controlled_proof(labelled(spark, sf), CLASSES, models.CLASSIFIERS, rate=0.1)


@query("regression_proof")
def _(spark, sf):
    return compare.controlled_proof(amounts(spark, sf), AMOUNTS, models.REGRESSORS, rate=0.1)


@query("tuned_repair_choice")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_outliers(labelled(spark, sf), "row_id", NUMBERS, 0.1, 3).frame)
    choice = compare.select_repair(hurt, CLASSES, models.CLASSIFIERS, compare.SINGLE_ARMS, 42, 50, 5)
    return spark.createDataFrame(list(choice.items()), "model string, arm string")


@query("gated_label_filter")
def _(spark, sf):
    hurt = cut_lineage(inject.inject_labels(labelled(spark, sf), "row_id", "size", 0.1, 3).frame)
    return compare.gated_label_filter(hurt, CLASSES)


@query("impact_runs")
def _(spark, sf):
    return compare.impact_runs(labelled(spark, sf), CLASSES, tuple(inject.INJECTORS), inject.RATES, (42, 43, 44), models.CLASSIFIERS)


@query("relevance_utility")
def _(spark, sf):
    return compare.relevance_utility(labelled(spark, sf), CLASSES, ["balance", "segment", "priority"], "random_forest")
