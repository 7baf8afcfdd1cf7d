"""Matrices, weights and grouped scores of many fits."""

import pytest
from pyspark.sql import functions as F

from sievestone.catalog import model_checks
from sievestone.operators import apply as ap
from sievestone.operators import models
from sievestone.operators.models import Task
from sievestone.operators.prepare import prepare
from sievestone.plans import compare, fits
from sievestone.plans.audit import audit
from sievestone.plans.fits import Fit, class_scores, encode, fit_all, fit_one

TASK = Task("row_id", "y", ["a", "b"], ["g"])


def table(spark, n=600):
    base = spark.range(n).select(F.col("id").alias("row_id"), (F.rand(1) * 10).alias("a"), F.when(F.rand(2) > 0.1, F.rand(3)).alias("b"), F.element_at(F.array(*[F.lit(x) for x in "pqr"]), (F.col("id") % 3 + 1).cast("int")).alias("g"))
    return base.withColumn("y", F.when(F.col("a") + F.when(F.col("g") == "p", 3).otherwise(0) > 6, "yes").otherwise("no")).cache()


def test_grouped_scores_equal_single_ones(spark):
    rows = [(f, l, p, [(c, round(x, 3)) for c, x in zip("abc", probs)]) for f in (0, 2) for l, p, probs in
            [("a", "a", (0.8, 0.1, 0.1)), ("a", "b", (0.3, 0.6, 0.1)), ("b", "b", (0.2, 0.5, 0.3)), ("c", "a", (0.5 + f / 20, 0.2, 0.3 - f / 20)), ("c", "c", (0.1, 0.1, 0.8)), ("b", "c", (0.1, 0.1, 0.8))]]
    scored = spark.createDataFrame(rows, "fit int, label string, prediction string, chances array<struct<cls string, p double>>")
    for r in class_scores(scored).collect():
        one = scored.filter(F.col("fit") == r.fit).withColumn("probs", F.transform("chances", lambda x: x["p"]))
        want = models.summary_scores(one).first()
        assert (r.accuracy, r.macro_f1, r.balanced_accuracy) == pytest.approx(tuple(want))
        assert r.auc == pytest.approx(models.macro_auc(one, ["a", "b", "c"]))


def test_fits_equal_evaluate_and_weights_leave_out(spark):
    data = table(spark)
    train, test = data.filter("row_id % 4 <> 0"), data.filter("row_id % 4 = 0")
    half = F.when(F.col("row_id") % 2 == 0, 1).otherwise(0)
    own = [Fit("all", "logistic", 1), Fit("all", "logistic", 1, weight=half), Fit("half", "logistic", 1), Fit("all", "neural_net", 1, weight=half * 2)]
    got = fit_all(TASK, {"all": train, "half": lambda: train.filter("row_id % 2 = 0")}, test, own)
    want = models.evaluate(TASK, "logistic", train, test, 1)
    assert (got[own[0]]["score"], got[own[0]]["auc"]) == pytest.approx((want["score"], want["auc"]), abs=1e-6)
    assert got[own[1]]["score"] == pytest.approx(got[own[2]]["score"], abs=0.03) and got[own[3]]["score"] > 0.5
    matrix = encode(TASK, train, test)
    assert matrix.size == 5 and fit_one(TASK, matrix, Fit("all", "logistic", 1, weight=F.lit(1))).numFeatures == 5


def test_scores_without_leaked_rows(spark):
    data = table(spark)
    train, test = data.filter("row_id % 4 <> 0"), data.filter("row_id % 4 = 0")
    copied = test.unionByName(train.limit(40).withColumn("row_id", F.col("row_id") + 10_000))
    held = compare.with_leaks(train, copied, ["a", "b", "g", "y"])
    assert held.filter("_leaked").count() == 40
    fit = Fit("all", "random_forest", 1, 10)
    plain = fit_all(TASK, {"all": train}, test, [fit])[fit]["score"]
    assert fit_all(TASK, {"all": train}, held, [fit], fresh=True)[fit]["score_fresh"] == pytest.approx(plain)


def test_typing_of_train_rows_holds_for_test_rows(spark):
    train = spark.createDataFrame([(i, "-999" if i < 3 else str(i), "n/a" if i % 7 == 0 else "x") for i in range(60)], "row_id long, v string, t string")
    test = spark.createDataFrame([(100, -999, None), (101, -9, "?"), (102, -9, "x"), (103, -9, "x")], "row_id long, v long, t string")
    typed = {r.row_id: (r.v, r.t) for r in prepare(train, "row_id").apply(test).collect()}
    assert typed == {100: (None, None), 101: (-9.0, None), 102: (-9.0, "x"), 103: (-9.0, "x")}
    assert [r.t for r in prepare(train, "row_id").apply(test.drop("t")).collect()] == [None] * 4


def test_forests_keep_node_ids_and_large_folds_follow_each_other(spark, monkeypatch):
    for made in (models.classifier("random_forest", 2, 0, 3, 7), models.regressor("random_forest", 3, 7)):
        assert made.getCacheNodeIds() and made.getCheckpointInterval() == -1
    data = table(spark).withColumn("_y", (F.col("y") == "yes").cast("double"))
    ready = models.fit_encoder(data, TASK.numbers, TASK.texts).transform(data).select("row_id", "y", "_y", "features").cache()
    kind, used = models.classifier("random_forest", 2, 0, 3, 7), []
    plain = kind.copy({kind.cacheNodeIds: False})
    monkeypatch.setattr(models, "together", lambda jobs, threads: used.append(threads) or [job() for job in jobs])
    keep = ["row_id", "prediction"]
    rows = lambda made: sorted(map(tuple, models.out_of_fold(ready, "row_id", "y", made, 3, 1, keep).collect()))
    small = rows(kind)
    monkeypatch.setattr(models, "FOREST_CELLS", 600 * 7 - 1)
    assert small == rows(plain) and len(small) == 600 and used == [3, 1]


def test_matrices_take_few_tasks():
    assert [fits.tasks_of(rows, 14, 12) for rows in (0, 900, 20_001, 103_064, 720_000, 7_200_000)] == [1, 1, 2, 6, 12, 72]
    assert fits.tasks_of(720_000, 3000, 12) == 36 and fits.tasks_of(720_000, 40, 12) == 15


def test_baseline_models_encode_once(spark, monkeypatch):
    data, seen = table(spark).select("row_id", (F.col("a") * 30).alias("quantity"), F.col("b").alias("balance"), F.lit(1.0).alias("items"), (F.col("row_id") % 11).cast("double").alias("discount"),
                                     F.col("g").alias("segment"), F.col("g").alias("priority"), F.when(F.col("y") == "yes", "big").otherwise("small").alias("size")), []
    monkeypatch.setattr(model_checks, "labelled", lambda spark, sf: data)
    for module in (fits, models):
        monkeypatch.setattr(module, "fit_encoder", lambda *a, made=models.fit_encoder: seen.append(1) or made(*a))
    rows = {r.model: r for r in model_checks.QUERIES["baseline_models"](spark, "").collect()}
    train, test = model_checks.parts(data)
    assert len(seen) == 1 and set(rows) == set(models.CLASSIFIERS)
    want = models.evaluate(model_checks.CLASSES, "logistic", train, test)
    assert (rows["logistic"].macro_f1, rows["logistic"].accuracy, rows["logistic"].auc) == pytest.approx((want["score"], want["accuracy"], want["auc"]), abs=1e-6)


def test_arms_are_made_without_numbering_a_log(spark, monkeypatch):
    numbered = []
    monkeypatch.setattr(ap, "hash_ranks", lambda *a, made=ap.hash_ranks: numbered.append(1) or made(*a))
    data = table(spark, 300)
    _, frames = compare.repair_arms(data, TASK, ("missing_values", "duplicates", "outliers"), 1, 5, 2)
    assert not numbered and frames["missing_values"].filter("b is null").count() == 0
    out = ap.apply_proposals((state := audit(data, "row_id", "y", detectors={"missing_values"})).prepared, state.proposals, {"missing_values"})
    assert out.log.filter("action = 'applied'").count() == data.filter("b is null").count() and out.log is out.log and len(numbered) == 1
