"""Forests grown from histograms, against the definition and against Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sievestone.operators import forest, models


def table(spark, n=4000):
    base = spark.range(n, numPartitions=3).select(F.col("id").alias("row_id"), (F.rand(1) * 10).alias("a"), F.floor(F.rand(2) * 4).cast("double").alias("b"), F.rand(3).alias("c"), F.randn(4).alias("noise"))
    score = F.col("a") + 3 * F.col("b") + F.col("noise")
    base = base.withColumn("label", F.when(score > 12, "x").when(score > 7, "y").otherwise("z")).withColumn("number", score).cache()
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(base)


def test_best_split_equals_all_splits_tried():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 5, (300, 2)), rng.integers(0, 3, 300), rng.integers(0, 4, 300)
    sums = np.zeros((1, 2, forest.BINS, 3))
    for f in range(2):
        np.add.at(sums, (0, f, x[:, f], y), w)
    gini = lambda own: 1 - sum((w[own & (y == c)].sum() / w[own].sum()) ** 2 for c in range(3))
    everyone = np.ones(300, bool)
    gain = {(f, b): gini(everyone) - sum(w[side].sum() / w.sum() * gini(side) for side in (x[:, f] <= b, x[:, f] > b)) for f in range(2) for b in range(4)}
    feature, split, whole, left = forest.best_splits(sums, 3)
    best = max(gain, key=gain.get)
    assert (feature[0], split[0]) == best
    assert whole[0].tolist() == [w[y == c].sum() for c in range(3)] and left[0].tolist() == [w[(y == c) & (x[:, best[0]] <= best[1])].sum() for c in range(3)]
    assert forest.best_splits(sums[:, :, :1].repeat(forest.BINS, 2) * 0, 3)[0][0] == -1


def test_thresholds_and_bootstrap():
    assert forest.cuts(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1])).tolist() == [1.5, 3.0]
    assert len(forest.cuts(np.arange(1000.0), np.ones(1000))) == forest.BINS - 1
    hashes, rows = np.arange(200_000).astype(np.uint64), np.arange(200_000)
    counts = lambda mean, tree: forest.Bootstrap(hashes, 3).counts(tree, rows, np.full(len(rows), mean)).astype(np.int64)
    for mean in (1, 2, 7, 300):
        assert counts(mean, 4).mean() == pytest.approx(mean, rel=0.02) and counts(mean, 4).var() == pytest.approx(mean, rel=0.05)
        assert (counts(mean, 4) == counts(mean, 4)).all()
        assert all(abs(np.corrcoef(counts(mean, 4), counts(mean, other))[0, 1]) < 0.01 for other in (5, 8))


def test_scores_like_the_other_forest(spark, monkeypatch):
    data = table(spark)
    classes = data.withColumn("_y", models.class_code("label", ["x", "y", "z"]))
    kind, keep = models.classifier("random_forest", 3, 0, 3, 20), ["row_id", "label", "_y", "probability", "prediction"]
    numbers = data.withColumn("_y", F.col("number"))
    other, kept = models.regressor("random_forest", 3, 20), ["row_id", "_y", "prediction"]
    right, gap = {}, {}
    for cells in (models.HISTOGRAM_CELLS, 0):
        monkeypatch.setattr(models, "HISTOGRAM_CELLS", cells)
        found = models.out_of_fold(classes, "row_id", "label", kind, 3, 1, keep).select("*", vector_to_array("probability").alias("p")).collect()
        assert sorted(r.row_id for r in found) == list(range(4000)) and all(sum(r.p) == pytest.approx(1) for r in found)
        right[cells] = sum(r.prediction == r._y for r in found) / len(found), sum(r.p[int(r._y)] for r in found) / len(found)
        found = models.out_of_fold(numbers, "row_id", None, other, 3, 1, kept).collect()
        assert sorted(r.row_id for r in found) == list(range(4000))
        gap[cells] = sum((r.prediction - r._y) ** 2 for r in found) / len(found)
    (old, own), (old_gap, own_gap) = right.values(), gap.values()
    assert own == pytest.approx(old, abs=0.02) and own_gap == pytest.approx(old_gap, rel=0.05)


def test_leaves_that_predict_the_same_are_one():
    grown = forest.Forest(1, [np.array([[0]]), np.array([[0, 0]])], [np.array([[7]], np.uint8), np.array([[3, 11]], np.uint8)])
    last = np.array([[[8.0, 2.0], [3.0, 1.0], [0.0, 4.0], [5.0, 1.0]]])
    nodes = [last.sum(1, keepdims=True), last.reshape(1, 2, 2, 2).sum(2), last]
    grown = forest._pruned(grown, nodes, 2)
    said = grown.predict(np.array([2, 5, 9, 20], np.uint8), range(1))
    assert said.tolist() == pytest.approx(np.array([[11 / 14, 3 / 14], [11 / 14, 3 / 14], [0, 1], [5 / 6, 1 / 6]]))


def test_importance_by_the_other_forest(spark, monkeypatch):
    from sievestone.operators import relevance

    data = table(spark).drop("features")
    task = models.Task("row_id", "label", ["a", "b", "c"], [])
    found = {}
    for cells in (models.HISTOGRAM_CELLS, 0):
        monkeypatch.setattr(models, "HISTOGRAM_CELLS", cells)
        rows = relevance.permutation_importance(task, data.filter("row_id % 3 > 0"), data.filter("row_id % 3 = 0"), 1, 20, 2).collect()
        found[cells] = {r["column"]: r["importance"] for r in rows}
    old, own = found.values()
    assert set(own) == {"a", "b", "c"} and all(own[c] == pytest.approx(old[c], abs=0.04) for c in own)
