"""Audit and repair of one table, end to end: type, detect, propose, decide, apply, report, write.

Two stages, as cost demands: `audit` does everything expensive once and keeps its proposals as a written table;
`repair` only joins them back, so another choice of repairs never detects again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.operators import apply as ap
from sievestone.operators import detect, policy
from sievestone.operators import propose as pr
from sievestone.operators.prepare import Prepared, prepare, wide_text_columns
from sievestone.operators.spelling import Spelling, analyse_spelling
from sievestone.session import cut_lineage

CHEAP = {"missing_values", "duplicates", "outliers", "inconsistency"}
MIN_TARGET_ROWS = 50


@dataclass
class Audit:
    prepared: Prepared
    proposals: DataFrame
    observed: DataFrame                       # one row per issue: rate, counts, candidates
    policy: DataFrame
    spelling: Spelling | None = None
    skipped: dict[str, str] = field(default_factory=dict)
    unmodelled: dict[str, int] = field(default_factory=dict)
    feature_report: DataFrame | None = None
    calibration: object | None = None

    @property
    def out_of_scope(self) -> set[str]:
        return set(getattr(self.calibration, "columns_left_out", ())) if self.calibration is not None else set()


@dataclass
class Repaired:
    cleaned: DataFrame
    log: DataFrame
    quality: DataFrame
    impact: DataFrame
    readiness: DataFrame
    aggressive: ap.Applied


def model_frame(prepared: Prepared, unmodelled) -> tuple[DataFrame, list[str], list[str]]:
    """The labelled rows and the columns model-based checks may use."""
    numbers = prepared.numbers
    texts = [c for c in prepared.texts if c not in unmodelled]
    frame = prepared.frame
    if prepared.target is not None:
        frame = frame.filter(F.col(f"`{prepared.target}`").isNotNull())
    return frame, numbers, texts


def audit(df: DataFrame, row_id: str, target: str | None = None, task: str = "classification", detectors: set[str] | None = None,
          declared: dict | None = None, keep=None, evidence: DataFrame | None = None, knn: bool = True, trees: int = 50,
          folds: int = 5, seed: int = 0, max_model_rows: int | None = None) -> Audit:
    """Detect problems and propose repairs. `detectors` defaults to the cheap ones plus the label check when there is a
    target; name 'feature_corruption', 'joint_outliers' or 'feature_relevance' to add the slow ones."""
    wanted = set(detectors) if detectors is not None else CHEAP | ({"label_errors"} if target else set())
    prepared = prepare(df, row_id, target, task, declared, keep)
    frame, spark = prepared.frame, df.sparkSession
    counts: dict[str, tuple[float, int]] = {}
    parts, skipped, spelling = [], {}, None
    everything = prepared.numbers + prepared.texts
    if "missing_values" in wanted:
        row = detect.missing_rates(frame, everything).first()
        counts["missing_values"] = (row["rate"], row["missing_cells"])
        parts.append(pr.propose_missing(prepared, knn))
    if "duplicates" in wanted:
        row = detect.duplicate_rate(frame, pr.record_columns(prepared)).first()
        counts["duplicates"] = (row["rate"], row["duplicate_rows"])
        if row["duplicate_rows"]:
            parts.append(pr.propose_duplicates(prepared))
    if "outliers" in wanted:
        if prepared.numbers:
            loose, strict = detect.fences(frame, prepared.numbers, ((detect.FLAG_K, detect.FLAG_TAILS), (detect.STRICT_K, detect.STRICT_TAILS)))
            row = detect.outlier_rates(frame, loose).first()
            counts["outliers"] = (row["rate"], row["outlier_rows"])
            parts.append(pr.propose_outliers(prepared, loose, strict))
        else:
            counts["outliers"] = (0.0, 0)
    if "inconsistency" in wanted:
        if prepared.texts:
            spelling = analyse_spelling(frame, prepared.texts)
            row = detect_spelling_rate(frame, row_id, spelling)
            counts["inconsistency"] = row
            parts.append(pr.propose_spelling(prepared, spelling))
        else:
            counts["inconsistency"] = (0.0, 0)
    unmodelled: dict[str, int] = {}
    slow = wanted & {"label_errors", "feature_corruption", "feature_relevance"}
    if slow:
        from sievestone.operators import features, labels

        unmodelled = wide_text_columns(prepared)
        model_rows, numbers, texts = model_frame(prepared, unmodelled)
        model_rows = cut_lineage(model_rows)
        if max_model_rows is not None and model_rows.count() > max_model_rows:
            from sievestone.operators.sampling import stratified_sample

            model_rows = cut_lineage(stratified_sample(model_rows, row_id, target, max_model_rows, seed))
        rows = model_rows.count()
        if "label_errors" in wanted:
            if target is None:
                skipped["label_errors"] = "needs a target"
            elif not numbers and not texts:
                skipped["label_errors"] = "needs a usable feature column"
            elif task == "regression" and rows < MIN_TARGET_ROWS:
                skipped["label_errors"] = "needs 50 rows with a target"
            elif task == "regression":
                scored = cut_lineage(labels.target_scores(model_rows, row_id, target, numbers, texts, folds, trees, seed))
                flagged = scored.filter(F.col("z") > labels.TARGET_Z)
                counts["label_errors"] = _row_share(scored, flagged)
                parts.append(pr.propose_target(flagged, target))
            else:
                scored = cut_lineage(labels.label_scores(model_rows, row_id, target, numbers, texts, folds, trees, seed))
                flagged = labels.noisy_labels(scored)
                counts["label_errors"] = _row_share(scored, flagged)
                parts.append(pr.propose_labels(flagged, target))
        if "feature_corruption" in wanted:
            if len(numbers) + len(texts) < 2:
                skipped["feature_corruption"] = "needs two usable feature columns"
            else:
                suspects = cut_lineage(features.cross_feature_scores(model_rows, row_id, numbers, texts, folds, trees, seed))
                flagged = features.suspicious_cells(suspects)
                hit_rows = flagged.select("row_id").distinct().count()
                counts["feature_corruption"] = (hit_rows / rows if rows else 0.0, hit_rows)
                parts.append(pr.propose_features(flagged, prepared.integer_like))
    if "joint_outliers" in wanted:
        from sievestone.operators import joint

        found = joint.joint_outliers(frame, row_id, prepared.numbers, prepared.integer_like, seed)
        if found.scopes:
            hits = found.records.filter("joint_only").select("row_id").distinct().count()
            counts["joint_outliers"] = (hits / prepared.rows, hits)
            parts.append(pr.propose_joint(found.records))
        else:
            skipped["joint_outliers"] = "; ".join(f"{k}: {v}" for k, v in found.declined.items())
    report = None
    if "feature_relevance" in wanted:
        from sievestone.operators import relevance

        report = relevance.assess_features(prepared, seed=seed, trees=trees, unmodelled=set(unmodelled))
    proposals = cut_lineage(pr.all_proposals(spark, parts))
    observed = observed_table(spark, counts, proposals)
    return Audit(prepared, proposals, observed, policy.build_policy(observed, evidence), spelling, skipped, unmodelled, report)


def detect_spelling_rate(frame: DataFrame, row_id: str, spelling: Spelling) -> tuple[float, int]:
    from sievestone.operators.spelling import spelling_rate

    row = spelling_rate(frame, row_id, spelling).first()
    return (row["rate"] or 0.0, row["flagged_rows"])


def _row_share(scored: DataFrame, flagged: DataFrame) -> tuple[float, int]:
    total, hits = scored.count(), flagged.count()
    return (hits / total if total else 0.0, hits)


def observed_table(spark, counts: dict[str, tuple[float, int]], proposals: DataFrame) -> DataFrame:
    """Seven rows: what each detector found and how many repairs or flags it proposed."""
    tiers = {(r["issue_key"], r["kind"]): r["count"] for r in proposals.groupBy(
        "issue_key", F.when(F.col("tier") == "loose", "flag").otherwise("repair").alias("kind")).count().collect()}
    rows = [(issue, issue in counts, counts[issue][0] if issue in counts else None, counts[issue][1] if issue in counts else None,
             tiers.get((issue, "repair"), 0), tiers.get((issue, "flag"), 0)) for issue in pr.ISSUES]
    return spark.createDataFrame(rows, ("issue_key string, detector_ran boolean, detected_rate double, detected_count long, "
                                        "n_repair_candidates long, n_flag_only long"))


def after_cleaning(cleaned: DataFrame, prepared: Prepared, declared=None, keep=None) -> DataFrame:
    """Rates of the cheap detectors on the cleaned table, which is written first: the detectors read it some fifteen times."""
    cleaned = cut_lineage(cleaned)
    again = prepare(cleaned, prepared.row_id, prepared.target, prepared.task, declared, keep)
    rates = {"missing_values": detect.missing_rates(again.frame, again.numbers + again.texts).first()["rate"],
             "duplicates": detect.duplicate_rate(again.frame, pr.record_columns(again)).first()["rate"]}
    rates["outliers"] = (detect.outlier_rates(again.frame, detect.fences(again.frame, again.numbers)[0]).first()["rate"] if again.numbers else 0.0)
    rates["inconsistency"] = (detect_spelling_rate(again.frame, again.row_id, analyse_spelling(again.frame, again.texts))[0] if again.texts else 0.0)
    return cleaned.sparkSession.createDataFrame([(k, float(v)) for k, v in rates.items()], "issue_key string, rate_after_cleaning double")


def attach_calibration(state: Audit, calibration) -> Audit:
    """Decide again with this table's own measured evidence."""
    state.calibration = calibration
    state.policy = policy.build_policy(state.observed, policy.with_source_priority(calibration.evidence, None))
    return state


def repair(state: Audit, issues: set[str] | None = None, with_after: bool = False) -> Repaired:
    """The evidence-based table (or the chosen issues), the aggressive one, and the reports."""
    default = policy.auto_issues(state.policy)
    chosen = default if issues is None else set(issues)
    overrides = chosen - default
    applied = ap.apply_proposals(state.prepared, state.proposals, chosen, overrides, hold_codes=True,
                                 out_of_scope=state.out_of_scope, policy=state.policy)
    aggressive = ap.apply_proposals(state.prepared, state.proposals, ap.AGGRESSIVE, ap.AGGRESSIVE - default, policy=state.policy)
    cal = state.calibration
    statuses = policy.evidence_status(state.observed, getattr(cal, "tracking", None), {})
    quality = policy.quality_report(state.observed, getattr(cal, "reliability", None), statuses)
    spark = state.proposals.sparkSession
    if cal is not None:
        estimates = policy.impact_estimates(state.observed.filter("detector_ran").select("issue_key", "detected_rate"), cal.curve)
    else:
        estimates = spark.createDataFrame([], "issue_key string, detected_rate double, impact_estimate double, is_boundary_estimate boolean")
    impact = policy.impact_report(state.policy, estimates, None, getattr(cal, "disagreement", None), chosen)
    floors = spark.createDataFrame(list(getattr(cal, "floors", {}).items()), "issue_key string, floor double")
    after = after_cleaning(applied.cleaned, state.prepared) if with_after else None
    return Repaired(applied.cleaned, applied.log, quality, impact, policy.readiness_report(quality, floors, after), aggressive)
