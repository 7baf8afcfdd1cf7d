"""Models before and after cleaning: the panel on the user's rows, the controlled proof on injected errors, and the
choice of a repair per model on a leak-free validation slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named, record_key
from sievestone.operators import apply as ap
from sievestone.operators import grade, policy
from sievestone.operators.inject import inject_all
from sievestone.operators.models import CLASSIFIERS, REGRESSORS, Task, classes_of, evaluate, score_model, summary_scores
from sievestone.operators.pool import together
from sievestone.operators.prepare import Prepared
from sievestone.operators.sampling import quantile_strata, split
from sievestone.plans.audit import audit
from sievestone.plans.calibrate import left_out, noise_level
from sievestone.plans.fits import Fit, fit_all
from sievestone.session import cut_lineage

SINGLE_ARMS = ("missing_values", "duplicates", "outliers", "inconsistency", "label_errors")
SELECT_MARGIN = 0.005
VALIDATION_SHARE = 0.25


def leaked_rows(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Test rows that also appear, all columns equal, in the training rows: a semi join on the record hash."""
    a = train.select(*record_key(columns)).distinct()
    return test.select("*", *record_key(columns)).join(a, ["record_1", "record_2"], "left_semi").drop("record_1", "record_2")


def with_leaks(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Test rows with `_leaked`: whether an equal row stands in the training rows."""
    keys = train.select(*record_key(columns)).distinct().withColumn("_seen", F.lit(True))
    joined = test.select("*", *record_key(columns)).join(keys, ["record_1", "record_2"], "left")
    return joined.withColumn("_leaked", F.col("_seen").isNotNull()).drop("record_1", "record_2", "_seen")


def _split(df: DataFrame, task: Task, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    stratum = task.target
    shaped = df
    if task.regression:
        shaped, stratum = df.withColumn("_stratum", quantile_strata(df, task.target)), "_stratum"
    parts = cut_lineage(split(shaped, task.row_id, stratum, [1 - share, share], seed))
    return parts.filter("part = 0").select(df.columns), parts.filter("part = 1").select(df.columns)


def repair_arms(train: DataFrame, task: Task, arms, seed: int, trees: int, folds: int, evidence: DataFrame | None = None) -> tuple[Prepared, dict[str, DataFrame]]:
    """The typing of the training rows, and those rows as they are, after each single repair, after all of them, and after the policy's own
    choice, all typed by it. Only training rows are read. An arm that changes nothing is left out and shares the raw fit."""
    state = audit(train, task.row_id, task.target, "regression" if task.regression else "classification", detectors=set(arms), evidence=evidence,
                  trees=trees, folds=folds, seed=seed)
    counts = {r["issue_key"]: r["n_repair_candidates"] for r in state.observed.collect()}
    chosen = {arm: {arm} for arm in arms if counts.get(arm)}
    if chosen:
        chosen["aggressive"] = set(arms)
    default = policy.auto_issues(state.policy) & set(arms)
    if default:
        chosen["default"] = default
    typed = state.prepared.apply
    made = together([lambda arm=arm, issues=issues: (arm, cut_lineage(typed(ap.apply_proposals(state.prepared, state.proposals, issues, issues, hold_codes=arm == "default").cleaned)))
                     for arm, issues in chosen.items()])
    return state.prepared, {"before": typed(train), **dict(made)}


def run_panel(df: DataFrame, task: Task, models=None, seeds=(42, 43), arms=SINGLE_ARMS, trees: int = 50, folds: int = 5, test_share: float = 0.2,
              evidence: DataFrame | None = None) -> DataFrame:
    """model, arm, mean score, mean change, verdict against the model's own noise floor, score without test rows that stand in train."""
    models = models or (REGRESSORS if task.regression else CLASSIFIERS)

    def one(seed):
        train, test = _split(df, task, test_share, seed)
        typing, frames = repair_arms(train, task, arms, seed, trees, folds, evidence)
        known = fewer(task, typing)
        held = cut_lineage(with_leaks(frames["before"], typing.apply(test), known.numbers + known.texts + [task.target]))
        leaked = held.agg(F.avg(F.col("_leaked").cast("double"))).first()[0] or 0.0
        fits = {(model, arm): Fit(arm, model, seed, trees) for model in models for arm in frames}
        draws = {(model, d): Fit("before", model, seed, trees, left_out(seed, d)) for model in models for d in range(2)} if seed == seeds[0] else {}
        got = fit_all(known, frames, held, [*fits.values(), *draws.values()], fresh=True)
        rows = []
        for model in models:
            base = got[fits[model, "before"]]
            for arm in ["before", "default", "aggressive", *arms]:
                own = got[fits[model, arm if arm in frames else "before"]]
                rows.append((model, arm, seed, own["score"], own["auc"], own["score"] - base["score"], arm not in frames or arm == "before", leaked, own["score_fresh"]))
        return rows, [(model, noise_level([got[draws[model, d]]["score"] - got[fits[model, "before"]]["score"] for d in range(2)])) for model in models] if draws else []

    found = together([lambda s=s: one(s) for s in seeds], 2)
    spark = df.sparkSession
    runs = spark.createDataFrame([r for rows, _ in found for r in rows], "model string, arm string, seed int, score double, auc double, change double, same boolean, leaked double, score_fresh double")
    levels = spark.createDataFrame([f for _, floors in found for f in floors], "model string, noise_floor double")
    return panel_table(runs.join(F.broadcast(levels), "model"))


def fewer(task: Task, typing: Prepared) -> Task:
    """The task on the columns that are left, as the typing knows them."""
    known = set(task.numbers + task.texts)
    return Task(task.row_id, task.target, [c for c in typing.numbers if c in known], [c for c in typing.texts if c in known], task.regression)


def panel_table(runs: DataFrame) -> DataFrame:
    """Verdicts from runs(model, arm, seed, score, auc, change, same, leaked, score_fresh, noise_floor)."""
    change = F.col("change")
    status = grade.status_of(grade.sign_agreement(change), F.avg(change), F.max("noise_floor"))
    verdict = (F.when(F.first("arm") == "before", "baseline").when(F.bool_and("same"), "no change")
               .when(F.max(F.abs(change)) == 0, "no effect").when(F.count(F.lit(1)) < 2, "not enough runs")
               .when(status == "positive", "improved").when(status == "negative", "worse").otherwise("within noise"))
    return runs.groupBy("model", "arm").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"), F.avg("auc").alias("auc_mean"),
        F.avg(change).alias("delta"), F.max("noise_floor").alias("noise_floor"), verdict.alias("verdict"), F.avg("leaked").alias("leaked_share"), F.avg("score_fresh").alias("score_without_leaks"))


def arm_interaction(panel: DataFrame) -> DataFrame:
    """Change with all repairs next to the sum of the single repairs."""
    return panel.groupBy("model").agg(F.max(F.when(F.col("arm") == "aggressive", F.col("delta"))).alias("all_repairs"),
                                      F.sum(F.when(F.col("arm").isin(*SINGLE_ARMS), F.col("delta"))).alias("sum_of_singles"))


def select_repair(dirty: DataFrame, task: Task, models, arms, seed: int, trees: int, folds: int) -> dict[str, str]:
    """Best arm per model on a quarter of the dirty rows that has no copy in the rest; raw unless it gains enough."""
    train, validation = _split(dirty, task, VALIDATION_SHARE, seed)
    columns = [c for c in dirty.columns if c != task.row_id]
    keys = train.select(*record_key(columns)).distinct()
    free = validation.select("*", *record_key(columns)).join(keys, ["record_1", "record_2"], "left_anti").select(validation.columns)
    typing, frames = repair_arms(train, task, arms, seed, trees, folds)
    frames.pop("default", None)
    fits = {(model, arm): Fit(arm, model, seed, trees) for model in models for arm in frames}
    got = fit_all(fewer(task, typing), frames, cut_lineage(typing.apply(free)), list(fits.values()), with_auc=False)
    choice = {}
    for model in models:
        scores = {arm: got[fits[model, arm]]["score"] for arm in frames}
        best = max((s, a) for a, s in scores.items())
        choice[model] = best[1] if best[0] - scores["before"] > SELECT_MARGIN else "before"
    return choice


def controlled_proof(df: DataFrame, task: Task, models=("logistic", "random_forest"), seeds=(42, 43), arms=SINGLE_ARMS, rate: float = 0.05, trees: int = 50,
                     folds: int = 5) -> DataFrame:
    """Errors injected into the training part only: clean, dirty and repaired training rows scored on the same clean test
    rows, with the share of the damage each repair recovers."""
    from sievestone.operators.inject import inject_missing, inject_outliers, inject_target_shift

    columns = task.numbers + task.texts

    def one(seed):
        train, test = _split(df, task, 0.2, seed)
        if task.regression:
            step = inject_missing(train, task.row_id, columns, rate, seed).frame
            step = inject_outliers(step, task.row_id, columns, rate, seed + 1).frame
            dirty = cut_lineage(inject_target_shift(step, task.row_id, task.target, rate, seed + 2).frame)
        else:
            dirty = cut_lineage(inject_all(train, task.row_id, columns, task.target, rate, seed).frame)
        (typing, frames), tuned = together([lambda: repair_arms(dirty, task, arms, seed, trees, folds), lambda: select_repair(dirty, task, models, arms, seed, trees, folds)])
        frames["clean"] = typing.apply(train)
        fits = {(model, arm): Fit(arm, model, seed, trees) for model in models for arm in frames}
        got = fit_all(fewer(task, typing), frames, typing.apply(test), list(fits.values()), with_auc=False)
        rows = []
        for model in models:
            scores = {arm: got[fits[model, arm]]["score"] for arm in frames}
            clean = scores.pop("clean")
            scores["tuned"] = scores.get(tuned[model], scores["before"])
            rows += [(model, arm, seed, clean, scores["before"], s) for arm, s in scores.items()]
        return rows

    rows = [r for found in together([lambda s=s: one(s) for s in seeds], 2) for r in found]
    runs = df.sparkSession.createDataFrame(rows, "model string, arm string, seed int, clean double, dirty double, score double")
    damage = F.avg(F.col("clean") - F.col("dirty"))
    return runs.groupBy("model", "arm").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("score").alias("score_mean"), damage.alias("damage"),
                                            F.avg(F.col("score") - F.col("dirty")).alias("delta"),
                                            F.when(damage > 0, F.avg(F.col("score") - F.col("dirty")) / damage).alias("share_recovered"))


def gated_label_filter(df: DataFrame, task: Task, model: str = "random_forest", thresholds=(0.2, 0.35), seed: int = 42, trees: int = 50, folds: int = 5) -> DataFrame:
    """Dropping doubtful labels, used only when it wins on a validation slice: threshold, score, chosen."""
    from sievestone.operators.labels import keep_trusted, label_scores

    train, validation = _split(df, task, VALIDATION_SHARE, seed)
    scored = cut_lineage(label_scores(train, task.row_id, task.target, task.numbers, task.texts, folds, trees, seed))
    arms = {0.0: train, **{float(t): keep_trusted(train, task.row_id, scored, t) for t in thresholds}}
    fits = [Fit(t, model, seed, trees) for t in arms]
    got = fit_all(task, arms, validation, fits, with_auc=False)
    rows = [(f.arm, got[f]["score"]) for f in fits]
    best = max(rows, key=lambda r: (r[1] - rows[0][1] > SELECT_MARGIN, r[1]))
    chosen = best[0] if best[1] - rows[0][1] > SELECT_MARGIN else 0.0
    return df.sparkSession.createDataFrame([(t, s, t == chosen) for t, s in rows], "threshold double, score double, chosen boolean")


def impact_runs(df: DataFrame, task: Task, issues, rates, seeds, models=("random_forest",), trees: int = 50) -> DataFrame:
    """Damage per (model, issue, rate, seed): one corruption is drawn and shared by all models."""
    from sievestone.operators.inject import INJECTORS

    train, test = _split(df, task, 0.3, seeds[0])
    columns = task.numbers + task.texts
    cells = [(issue, rate, seed) for issue in issues for rate in rates for seed in seeds]
    arms = {"clean": train, **{cell: lambda c=cell: cut_lineage(INJECTORS[c[0]](train, task.row_id, columns, task.target, c[1], c[2]).frame) for cell in cells}}
    base = {(m, seed): Fit("clean", m, seed, trees) for m in models for seed in seeds}
    fits = {(m, *cell): Fit(cell, m, cell[2], trees) for m in models for cell in cells}
    got = fit_all(task, arms, test, [*base.values(), *fits.values()], with_auc=False)
    rows = []
    for (m, issue, rate, seed), fit in fits.items():
        clean, dirty = got[base[m, seed]]["score"], got[fit]["score"]
        rows.append((m, issue, float(rate), seed, clean, dirty, clean - dirty))
    return df.sparkSession.createDataFrame(rows, "model string, issue string, rate double, seed int, clean double, dirty double, damage double")


def relevance_utility(df: DataFrame, task: Task, flagged: list[str], model: str = "random_forest", seed: int = 42, trees: int = 50) -> DataFrame:
    """Score with and without the columns flagged as irrelevant."""
    train, test = _split(df, task, 0.3, seed)
    fewer = Task(task.row_id, task.target, [c for c in task.numbers if c not in flagged], [c for c in task.texts if c not in flagged], task.regression)
    rows = [(name, evaluate(t, model, train, test, seed, trees, with_auc=False)["score"]) for name, t in (("all columns", task), ("without flagged", fewer))]
    return df.sparkSession.createDataFrame(rows, "columns string, score double")


def cross_validated(df: DataFrame, task: Task, model: str, k: int = 5, seed: int = 0, trees: int = 50) -> DataFrame:
    """Mean and deviation of the headline scores over k folds."""
    from sievestone.operators.sampling import folds as with_folds

    parts = with_folds(df, task.row_id, None if task.regression else task.target, k, seed).persist()
    classes = classes_of(df, task.target)
    rows = together([lambda f=f: tuple(summary_scores(score_model(task, model, parts.filter(F.col("fold") != f), parts.filter(F.col("fold") == f), seed, trees, classes)).first()) for f in range(k)])
    parts.unpersist()
    out = df.sparkSession.createDataFrame(rows, "accuracy double, macro_f1 double, balanced_accuracy double")
    return out.agg(*[e for c in ("accuracy", "macro_f1", "balanced_accuracy") for e in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))])
