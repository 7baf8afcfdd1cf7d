"""Cells that do not fit the rest of their row: each column predicted from the others, or PCA reconstruction error."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.operators.models import class_code, classes_of, classifier, fit_encoder, out_of_fold, regressor
from sievestone.operators.propose import modes
from sievestone.operators.quantiles import medians

FLAG_P, FLAG_Z = 0.05, 4.0


def cross_feature_scores(df: DataFrame, row_id: str, numbers: list[str], texts: list[str], k: int = 5, trees: int = 150, seed: int = 0) -> DataFrame:
    """row_id, column, kind, observed, predicted, predicted_number, score for every cell of the modelled columns. Missing
    cells of the predicted column are filled first so that every row is scored."""
    frequent, middle = modes(df, texts), medians(df, numbers)
    out = None
    for c in texts + numbers:
        is_text = c in texts
        fill = frequent.get(c) if is_text else middle[c]
        if fill is None:
            continue
        rest_numbers, rest_texts = [n for n in numbers if n != c], [t for t in texts if t != c]
        filled = df.withColumn("_filled", F.coalesce(named(c), F.lit(fill)))
        if is_text:
            classes = classes_of(filled, "_filled")
            filled = filled.withColumn("_y", class_code("_filled", classes))
        else:
            filled = filled.withColumn("_y", named("_filled").cast("double"))
        ready = fit_encoder(filled, rest_numbers, rest_texts).transform(filled).select(
            named(row_id).alias("row_id"), named(c).cast("string").alias("observed"), F.col("_filled").cast("string").alias("stratum"), "_y", "features")
        if is_text:
            scored = out_of_fold(ready, "row_id", "stratum", classifier("random_forest", len(classes), 0, seed, trees), k, seed,
                                 ["row_id", "observed", "_y", "probability", "prediction"])
            probs = vector_to_array("probability")
            names = F.array(*[F.lit(v) for v in classes])
            part = scored.select("row_id", F.lit(c).alias("column"), F.lit("text").alias("kind"), "observed",
                                 F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.lit(None).cast("double").alias("predicted_number"),
                                 F.element_at(probs, (F.col("_y") + 1).cast("int")).alias("score"))
        else:
            scored = out_of_fold(ready, "row_id", None, regressor("random_forest", seed, trees), k, seed, ["row_id", "observed", "_y", "prediction"])
            residual = F.col("_y") - F.col("prediction")
            m = scored.agg(F.avg(residual).alias("m"), F.stddev_pop(residual).alias("s")).first()
            part = scored.select("row_id", F.lit(c).alias("column"), F.lit("number").alias("kind"), "observed", F.lit(None).cast("string").alias("predicted"),
                                 F.col("prediction").alias("predicted_number"), F.abs((residual - F.lit(m["m"])) / F.lit(m["s"] + 1e-9)).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def suspicious_cells(scores: DataFrame) -> DataFrame:
    return scores.filter(F.when(F.col("kind") == "text", F.col("score") < FLAG_P).otherwise(F.col("score") > FLAG_Z))


def pca_errors(df: DataFrame, row_id: str, numbers: list[str], texts: list[str], variance: float = 0.95, k_std: float = 3.0) -> DataFrame:
    """row_id, error, flagged: mean squared reconstruction error beyond mean + 3 deviations. For orthonormal components the
    error is |x|^2 - |projection|^2, so nothing has to be rebuilt."""
    encoder = fit_encoder(df, numbers, texts)
    encoded = encoder.transform(df).select(named(row_id).alias("row_id"), "features")
    centred = StandardScaler(inputCol="features", outputCol="x", withMean=True, withStd=False).fit(encoded).transform(encoded)
    width = centred.select(F.size(vector_to_array("x")).alias("n")).first()["n"]
    full = PCA(k=width, inputCol="x", outputCol="p").fit(centred)
    shares, total, used = full.explainedVariance.toArray(), 0.0, 0
    for share in shares:
        total += share
        used += 1
        if total >= variance:
            break
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    projected = F.slice(vector_to_array("p"), 1, used)
    scored = full.transform(centred).select("row_id", (F.greatest(square(vector_to_array("x")) - square(projected), F.lit(0.0)) / F.lit(width)).alias("error"))
    m = scored.agg(F.avg("error").alias("m"), F.stddev_pop("error").alias("s")).first()
    return scored.withColumn("flagged", F.col("error") > F.lit(m["m"] + k_std * m["s"]))


def pca_variance(df: DataFrame, numbers: list[str]) -> DataFrame:
    """component, explained share, cumulative share and the reconstruction error left after it (standardised columns)."""
    encoded = fit_encoder(df, numbers, []).transform(df).select("features")
    shares = PCA(k=len(numbers), inputCol="features", outputCol="p").fit(encoded).explainedVariance.toArray().tolist()
    rows, so_far = [], 0.0
    for i, share in enumerate(shares, start=1):
        so_far += share
        rows.append((i, float(share), so_far, max(0.0, 1 - so_far)))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, reconstruction_error double")
