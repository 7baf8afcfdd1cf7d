"""Wrong labels and wrong numeric targets, by out-of-fold random forests."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.operators.models import class_code, classes_of, classifier, fit_encoder, out_of_fold, regressor
from sievestone.operators.stats import banded_robust_z

FLAG_CONFIDENCE = 0.9
TARGET_Z = 4.0


def label_scores(df: DataFrame, row_id: str, target: str, numbers: list[str], texts: list[str], k: int = 5, trees: int = 200, seed: int = 0) -> DataFrame:
    """row_id, label, predicted, confidence, given_probability for every labelled row."""
    classes = classes_of(df, target)
    rows = df.filter(named(target).isNotNull()).withColumn("_y", class_code(target, classes))
    ready = fit_encoder(rows, numbers, texts).transform(rows).select(named(row_id).alias("row_id"), named(target).cast("string").alias("label"), "_y", "features")
    model = classifier("random_forest", len(classes), 0, seed, trees)
    scored = out_of_fold(ready, "row_id", "label", model, k, seed, ["row_id", "label", "_y", "probability", "prediction"])
    probs = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select("row_id", "label", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"),
                         F.array_max(probs).alias("confidence"), F.element_at(probs, (F.col("_y") + 1).cast("int")).alias("given_probability"))


def noisy_labels(scored: DataFrame, confidence: float = FLAG_CONFIDENCE) -> DataFrame:
    """Rows where the model is confident about another class."""
    return scored.filter((F.col("predicted") != F.col("label")) & (F.col("confidence") >= confidence))


def keep_trusted(df: DataFrame, row_id: str, scored: DataFrame, threshold: float) -> DataFrame:
    """Rows whose given label has at least `threshold` out-of-fold probability."""
    doubted = scored.filter(F.col("given_probability") < threshold).select(F.col("row_id").alias("_doubted"))
    return df.join(doubted, named(row_id) == F.col("_doubted"), "left_anti")


def target_scores(df: DataFrame, row_id: str, target: str, numbers: list[str], texts: list[str], k: int = 5, trees: int = 200, seed: int = 0) -> DataFrame:
    """row_id, label, predicted, z: how far each numeric target lies from its out-of-fold prediction."""
    rows = df.filter(named(target).isNotNull()).withColumn("_y", named(target).cast("double"))
    ready = fit_encoder(rows, numbers, texts).transform(rows).select(named(row_id).alias("row_id"), "_y", "features")
    scored = out_of_fold(ready, "row_id", None, regressor("random_forest", seed, trees), k, seed, ["row_id", "_y", "prediction"])
    from sievestone.session import cut_lineage

    scored = cut_lineage(scored.select("row_id", F.col("_y").alias("label"), F.col("prediction").alias("predicted")).withColumn(
        "residual", F.col("label") - F.col("predicted")))
    return scored.join(banded_robust_z(scored, "row_id", "residual", "predicted"), "row_id").select("row_id", "label", "predicted", "z")
