"""Spark ML building blocks: filling and encoding, model families, out-of-fold prediction, and exact metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.operators import forest
from sievestone.operators.detect import value_counts
from sievestone.operators.pool import together
from sievestone.operators.quantiles import medians
from sievestone.operators.ranks import running_totals
from sievestone.operators.sampling import folds as with_folds
from sievestone.session import cut_lineage

CLASSIFIERS = ("logistic", "random_forest", "boosting", "neural_net")
REGRESSORS = ("ridge", "random_forest", "boosting")
MAX_LEVELS = 1000  # of a text column on average; more are refused, not cut
FOREST_CELLS = 50_000_000  # rows x trees of one fold; larger folds are fitted one after the other, as each keeps four numbers a cell
HISTOGRAM_CELLS = 60_000_000  # rows x trees; more are grown from histograms of binned rows (`forest`), by the same rules with other draws


@dataclass
class Encoder:
    """Fills (median, most frequent) and encodes (one-hot, standardised) features into `features`; fitted once."""

    numbers: list[str]
    texts: list[str]
    middle: dict
    frequent: dict
    levels: dict[str, list[str]]
    centre: dict[str, tuple[float, float]]

    @property
    def size(self) -> int:
        return sum(len(v) for v in self.levels.values()) + len(self.numbers)

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with the vector: one place per known level of each text (all zero for another value), then the numbers."""
        filled = _filled(df, self.numbers, self.texts, self.middle, self.frequent)
        places = [(F.col(f"_t{i}") == F.lit(level)).cast("double") for i, c in enumerate(self.texts) for level in self.levels[c]]
        for i, c in enumerate(self.numbers):
            mean, spread = self.centre[c]
            places.append(((F.col(f"_n{i}") - F.lit(mean)) / F.lit(spread)) if spread else F.lit(0.0))
        return filled.withColumn("features", array_to_vector(F.array(*places)))


def _filled(df, numbers, texts, middle, frequent):
    return df.select("*", *[F.coalesce(named(c).cast("double"), F.lit(float(middle[c] or 0.0))).alias(f"_n{i}") for i, c in enumerate(numbers)],
                     *[F.coalesce(named(c), F.lit(frequent.get(c) or "missing")).alias(f"_t{i}") for i, c in enumerate(texts)])


def fit_encoder(train: DataFrame, numbers: list[str], texts: list[str], scale: bool = True) -> Encoder:
    """Medians, moments of the filled numbers, and counted levels: the levels a text may have are bounded by the typing step. Modes and levels
    come from one count of values."""
    middle = medians(train, numbers)
    counts: dict[str, dict[str, int]] = {c: {} for c in texts}
    if texts:
        found = value_counts(train, texts).limit(MAX_LEVELS * len(texts) + 1).collect()
        if len(found) > MAX_LEVELS * len(texts):
            raise ValueError(f"more than {MAX_LEVELS} levels a text column: leave out texts that are no categories")
        for row in found:
            counts[row["column"]][row["value"]] = row["n"]
    frequent = {c: min(found, key=lambda v: (-found[v], v)) for c, found in counts.items() if found}
    rows = train.count() if texts else 0
    levels = {}
    for c in texts:
        present = set(counts[c])
        if sum(counts[c].values()) < rows:
            present.add(frequent.get(c) or "missing")
        levels[c] = sorted(present)
    centre = {c: (0.0, 1.0) for c in numbers}
    if numbers and scale:
        filled = _filled(train, numbers, [], middle, {})
        row = filled.agg(*[e for i in range(len(numbers)) for e in (F.avg(f"_n{i}").alias(f"m{i}"), F.stddev_samp(f"_n{i}").alias(f"s{i}"))]).first()
        centre = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(numbers)}
    return Encoder(numbers, texts, middle, frequent, levels, centre)


def classes_of(df: DataFrame, target: str) -> list[str]:
    """The sorted classes; more than a thousand are refused, not cut (the typing step already refuses more than twenty)."""
    found = sorted(r[0] for r in df.filter(named(target).isNotNull()).select(named(target).cast("string")).distinct().limit(1001).collect())
    if len(found) > 1000:
        raise ValueError(f"{target} has more than 1000 classes")
    return found


def class_code(target: str, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), named(target).cast("string")) - 1).cast("double")


def classifier(kind: str, n_classes: int, size: int, seed: int = 0, trees: int = 50):
    if kind == "logistic":
        return LogisticRegression(maxIter=100, labelCol="_y")
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, labelCol="_y", cacheNodeIds=True, checkpointInterval=-1)
    if kind == "boosting":
        boost = GBTClassifier(maxIter=max(5, trees // 5), maxDepth=4, seed=seed, labelCol="_y")
        return boost if n_classes == 2 else OneVsRest(classifier=boost, labelCol="_y")
    if kind == "neural_net":
        return MultilayerPerceptronClassifier(layers=[size, 64, n_classes], maxIter=60, seed=seed, labelCol="_y")
    if kind == "tree":
        return DecisionTreeClassifier(labelCol="_y", seed=seed)
    raise ValueError(f"unknown classifier {kind!r}")


def regressor(kind: str, seed: int = 0, trees: int = 50):
    if kind == "ridge":
        return LinearRegression(regParam=0.01, elasticNetParam=0.0, labelCol="_y")
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=trees, maxDepth=8, seed=seed, labelCol="_y", cacheNodeIds=True, checkpointInterval=-1)
    if kind == "boosting":
        return GBTRegressor(maxIter=max(5, trees // 5), maxDepth=4, seed=seed, labelCol="_y")
    raise ValueError(f"unknown regressor {kind!r}")


# --- out-of-fold -------------------------------------------------------------------------------------------------
def out_of_fold(df: DataFrame, row_id: str, stratum: str | None, estimator, k: int, seed: int, keep: list[str]) -> DataFrame:
    """Every row scored by a model that never saw it. `df` holds `features` and `_y`; the k scored parts are disjoint, so
    their union has each row once. The encoder is fitted once on all rows: it never sees the label. Small folds are fitted side by side."""
    split = with_folds(df, row_id, stratum, k, seed).persist()
    trees = estimator.getNumTrees() if estimator.hasParam("numTrees") else 1
    rows = split.count()
    if trees > 1 and rows * trees > HISTOGRAM_CELLS:
        whole = cut_lineage(forest.out_of_fold(split, estimator, k, keep))
        split.unpersist()
        return whole
    at_once = k if rows * trees <= FOREST_CELLS else 1

    def scored(fold):
        model = estimator.copy().fit(split.filter(F.col("fold") != fold))
        return model.transform(split.filter(F.col("fold") == fold)).select(*keep)

    whole = cut_lineage(reduce(DataFrame.unionByName, together([lambda f=f: scored(f) for f in range(k)], at_once)))
    split.unpersist()
    return whole


# --- metrics -----------------------------------------------------------------------------------------------------
def confusion(scored: DataFrame) -> DataFrame:
    """label, prediction, n."""
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_report(scored: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, F1, specificity (0 where undefined)."""
    counts = confusion(scored)
    total = counts.agg(F.sum("n").alias("total"))
    actual = counts.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    given = counts.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("given"))
    joined = actual.join(given, "cls", "full").na.fill(0).join(F.broadcast(total))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, given_n = F.col("tp"), F.col("support"), F.col("given")
    p, r = ratio(tp, given_n), ratio(tp, support)
    return joined.select("cls", "support", p.alias("precision"), r.alias("recall"), ratio(2 * tp, support + given_n).alias("f1"),
                         ratio(F.col("total") - support - given_n + tp, F.col("total") - support).alias("specificity"))


def summary_scores(scored: DataFrame) -> DataFrame:
    """accuracy, macro F1, balanced accuracy in one row."""
    report = class_report(scored)
    return report.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
                      F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def auc(scored: DataFrame, hit: Column, score: Column) -> float | None:
    """Exact ROC-AUC with ties counted half, from counts per distinct score."""
    counts = scored.select(score.alias("s"), hit.cast("long").alias("y")).groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    row = running_totals(counts, "s", ["neg"]).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return None if not row["p"] or not row["n"] else row["wins"] / (float(row["p"]) * float(row["n"]))


def macro_auc(scored: DataFrame, classes: list[str], probability: str = "probs") -> float | None:
    if len(classes) == 2:
        return auc(scored, F.col("label") == classes[1], F.round(F.col(probability)[1], 9))
    values = [auc(scored, F.col("label") == c, F.round(F.col(probability)[i], 9)) for i, c in enumerate(classes)]
    return None if any(v is None for v in values) else sum(values) / len(values)


def regression_scores(scored: DataFrame, target: str = "label", predicted: str = "prediction") -> DataFrame:
    """R2, RMSE, MAE and the RMSE of always predicting the mean."""
    y, p = F.col(target), F.col(predicted)
    return scored.agg((1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
                      F.avg(F.abs(y - p)).alias("mae"), F.stddev_pop(y).alias("mean_rmse"))


def threshold_sweep(scored: DataFrame, hit: Column, score: Column, thresholds=None) -> DataFrame:
    """precision, recall, F1 and accuracy at each threshold; all thresholds in one aggregation."""
    thresholds = thresholds or [round(0.05 * i, 2) for i in range(1, 20)]
    aggregates = [F.count_if(hit).alias("pos"), F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        aggregates += [F.count_if(hit & (score >= t)).alias(f"tp{i}"), F.count_if(score >= t).alias(f"g{i}")]
    wide = scored.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"g{i}").alias("given"), F.col("pos"), F.col("total"))
                     for i, t in enumerate(thresholds)])
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, given, pos, total = (F.col(c) for c in ("tp", "given", "pos", "total"))
    return long.select("threshold", ratio(tp, given).alias("precision"), ratio(tp, pos).alias("recall"), ratio(2 * tp, given + pos).alias("f1"),
                       ((total - pos - given + 2 * tp) / total).alias("accuracy"))


# --- one fit -----------------------------------------------------------------------------------------------------
@dataclass
class Task:
    """What a model is trained on: feature columns, target, kind of task."""

    row_id: str
    target: str
    numbers: list[str]
    texts: list[str]
    regression: bool = False


def score_model(task: Task, kind: str, train: DataFrame, test: DataFrame, seed: int = 0, trees: int = 50, classes: list[str] | None = None) -> DataFrame:
    """Test rows with label, prediction and (classification) class probabilities."""
    encoder = fit_encoder(train, task.numbers, task.texts)
    if task.regression:
        model = regressor(kind, seed, trees).fit(encoder.transform(train.withColumn("_y", named(task.target).cast("double"))))
        return model.transform(encoder.transform(test)).select(named(task.row_id).alias("row_id"), named(task.target).cast("double").alias("label"), "prediction")
    classes = classes or classes_of(train, task.target)
    ready = encoder.transform(train.withColumn("_y", class_code(task.target, classes)).filter("_y >= 0"))
    vector = encoder.size if kind != "neural_net" else ready.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    model = classifier(kind, len(classes), vector, seed, trees).fit(ready)
    scored = model.transform(encoder.transform(test))
    names = F.array(*[F.lit(c) for c in classes])
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
    else:
        probs = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: (i.cast("double") == F.col("prediction")).cast("double"))
    return scored.select(named(task.row_id).alias("row_id"), named(task.target).cast("string").alias("label"),
                         F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("prediction"), probs.alias("probs"))


def evaluate(task: Task, kind: str, train: DataFrame, test: DataFrame, seed: int = 0, trees: int = 50, with_auc: bool = True) -> dict:
    """One fit, its headline scores. Only the scores come back to the driver."""
    if task.regression:
        row = regression_scores(score_model(task, kind, train, test, seed, trees)).first()
        return {"score": row["r2"], "rmse": row["rmse"], "mae": row["mae"], "auc": None}
    classes = classes_of(train, task.target)
    scored = score_model(task, kind, train, test, seed, trees, classes).persist()
    row = summary_scores(scored).first()
    out = {"score": row["macro_f1"], "accuracy": row["accuracy"], "auc": macro_auc(scored, classes) if with_auc else None}
    scored.unpersist()
    return out


def least_squares(df: DataFrame, target: str, predictors: list[str]) -> dict:
    """Ordinary least squares with inference from the normal equations: all cross products come from one aggregation and
    only a (p+1) x (p+1) matrix reaches the driver."""
    import numpy as np

    from sievestone.functions.normal import student_cdf, student_quantile

    columns = [F.lit(1.0)] + [named(p).cast("double") for p in predictors]
    rows = df.dropna(subset=[target, *predictors])
    y = named(target).cast("double")
    size = len(columns)
    products = [F.sum(columns[i] * columns[j]).alias(f"x{i}_{j}") for i in range(size) for j in range(i, size)]
    row = rows.agg(*products, *[F.sum(columns[i] * y).alias(f"y{i}") for i in range(size)], F.sum(y * y).alias("yy"), F.sum(y).alias("sy"),
                   F.count(F.lit(1)).alias("n")).first()
    xtx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
    xty = np.array([row[f"y{i}"] for i in range(size)], float)
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    n = row["n"]
    rss = max(row["yy"] - float(beta @ xty), 0.0)
    tss = row["yy"] - row["sy"] ** 2 / n
    dof = n - size
    sigma2 = rss / dof
    error = np.sqrt(np.diag(inverse) * sigma2)
    t = beta / error
    critical = student_quantile(0.975, dof)
    r2 = 1 - rss / tss
    return {"names": ["intercept", *predictors], "coef": beta.tolist(), "se": error.tolist(), "t": t.tolist(),
            "p": [2 * (1 - student_cdf(abs(v), dof)) for v in t], "low": (beta - critical * error).tolist(), "high": (beta + critical * error).tolist(),
            "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / dof, "f": (r2 / (size - 1)) / ((1 - r2) / dof) if r2 < 1 else math.inf, "residual_std": math.sqrt(sigma2), "n": n}


def variance_inflation(df: DataFrame, predictors: list[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix."""
    import numpy as np

    from sievestone.operators.stats import correlation

    r = {(row["a"], row["b"]): row["r"] for row in correlation(df, predictors).collect()}
    matrix = np.array([[r.get((a, b), r.get((b, a))) for b in predictors] for a in predictors], float)
    return dict(zip(predictors, np.diag(np.linalg.inv(matrix)).tolist()))
