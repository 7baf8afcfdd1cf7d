"""Apply or review: evidence looked up per issue, the decision rule, and the report tables.

Everything here has one row per issue (seven) or per evidence cell (issue x rate), whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievestone.operators.grade import SAFE_MAX_RISK, SAFE_MIN_PRECISION, stricter

NEVER_AUTO = ["label_errors", "feature_corruption", "joint_outliers"]
FLAG_ONLY = ["joint_outliers"]
PROPOSAL_ONLY_WHEN_BORROWED = ["duplicates"]
# Fixed texts.
DIMENSIONS = {"missing_values": "Completeness", "duplicates": "Uniqueness", "outliers": "Anomaly burden",
              "label_errors": "Label reliability", "feature_corruption": "Feature reliability",
              "inconsistency": "Consistency", "joint_outliers": "Joint plausibility"}
DETECTOR_TYPES = {"missing_values": ("exact check", "cells"), "duplicates": ("exact check", "rows"),
                  "outliers": ("statistical estimate", "rows"), "inconsistency": ("rule-based check", "rows"),
                  "label_errors": ("statistical estimate", "rows"), "feature_corruption": ("statistical estimate", "rows"),
                  "joint_outliers": ("statistical estimate", "rows")}
RECOMMENDATIONS = {
    "positive": "Apply it: measurements show a gain.",
    "negative": "Leave it to a person: measurements show a loss.",
    "weak": "Check first: measurements point both ways.",
    "unknown": "Nothing was measured for this issue.",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def nearest_evidence(observed: DataFrame, evidence: DataFrame) -> DataFrame:
    """`observed(issue_key, detected_rate)` with the evidence row measured at the nearest rate; ties take the lower rate."""
    joined = observed.join(evidence.withColumnRenamed("error_type", "issue_key"), "issue_key")
    gap = F.round(F.abs(F.col("rate") - F.col("detected_rate")), 12)
    order = W.partitionBy("issue_key").orderBy(gap, "rate")
    return joined.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def with_source_priority(own: DataFrame | None, published: DataFrame | None) -> DataFrame:
    """Own calibration first; the published table only for issues it did not measure."""
    columns = ["error_type", "rate", "repairability_status", "risk", "repair_precision", "repair_recall", "mean_damage",
               "material_risk", "underpowered", "noise_floor", "source"]

    def shaped(frame, source):
        for name, kind in (("material_risk", "double"), ("underpowered", "boolean"), ("noise_floor", "double")):
            if name not in frame.columns:
                frame = frame.withColumn(name, F.lit(None).cast(kind))
        return frame.withColumn("source", F.lit(source)).select(*columns)

    if own is None or published is None:
        return shaped(own if own is not None else published, "own" if own is not None else "published")
    rest = published.join(own.select("error_type").distinct(), "error_type", "left_anti")
    return shaped(own, "own").unionByName(shaped(rest, "published"))


def second_model_check(evidence: DataFrame, second: DataFrame) -> DataFrame:
    """Published evidence joined to a second model at the same key: agreement, the stricter status, the larger risk."""
    other = second.select("error_type", "rate", F.col("repairability_status").alias("_status"), F.col("risk").alias("_risk"),
                          F.col("repair_precision").alias("_precision"))
    out = evidence.join(other, ["error_type", "rate"], "left")
    tested = F.col("_status").isNotNull() & (F.col("source") == "published")
    safe = (F.col("_risk") <= SAFE_MAX_RISK) & (F.col("_precision") >= SAFE_MIN_PRECISION) & (F.col("_status") != "negative")
    return (out.withColumn("model_check", F.when(~tested, "not tested").when(
                F.col("_status") == F.col("repairability_status"), "agree").otherwise("model-dependent"))
            .withColumn("second_ok", F.when(tested, safe).otherwise(True))
            .withColumn("repairability_status", F.when(tested, stricter(F.col("repairability_status"), F.col("_status")))
                        .otherwise(F.col("repairability_status")))
            .withColumn("risk", F.when(tested, F.greatest("risk", "_risk")).otherwise(F.col("risk")))
            .drop("_status", "_risk", "_precision"))


def impact_estimates(observed: DataFrame, curve: DataFrame, damage: str = "mean_damage") -> DataFrame:
    """Damage at the detected rate by linear interpolation from (0, 0); flat and marked beyond the highest rate."""
    known = curve.filter(F.col(damage).isNotNull()).select("error_type", "rate", F.col(damage).alias("damage"))
    origin = known.select("error_type").distinct().select("error_type", F.lit(0.0).alias("rate"), F.lit(0.0).alias("damage"))
    order = W.partitionBy("error_type").orderBy("rate")
    pieces = known.unionByName(origin).select(
        F.col("error_type").alias("issue_key"), F.col("rate").alias("r0"), F.col("damage").alias("d0"),
        F.lead("rate").over(order).alias("r1"), F.lead("damage").over(order).alias("d1"))
    inside = (F.col("detected_rate") >= F.col("r0")) & (F.col("r1").isNull() | (F.col("detected_rate") < F.col("r1")))
    return observed.join(pieces, "issue_key").filter(inside).select(
        "issue_key", "detected_rate",
        F.when(F.col("r1").isNull(), F.col("d0")).otherwise(
            F.col("d0") + (F.col("d1") - F.col("d0")) * (F.col("detected_rate") - F.col("r0")) / (F.col("r1") - F.col("r0")))
        .alias("impact_estimate"),
        (F.col("r1").isNull() & (F.col("detected_rate") > F.col("r0"))).alias("is_boundary_estimate"))


def safe_auto(evidence: DataFrame) -> DataFrame:
    """The gate over an evidence table, without the issue-specific guards."""
    return evidence.withColumn("safe_auto", (F.col("risk") <= SAFE_MAX_RISK) & (F.col("repair_precision") >= SAFE_MIN_PRECISION)
                               & (F.col("repairability_status") != "negative"))


def build_policy(observed: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """One decision per issue. `observed`: issue_key, detector_ran, detected_rate, n_repair_candidates, n_flag_only."""
    issue = F.col("issue_key")
    if evidence is None:
        found = observed
        for name, kind in (("rate", "double"), ("repairability_status", "string"), ("risk", "double"), ("repair_precision", "double"),
                           ("material_risk", "double"), ("underpowered", "boolean"), ("source", "string"),
                           ("second_ok", "boolean"), ("model_check", "string")):
            found = found.withColumn(name, F.lit(None).cast(kind))
    else:
        if "second_ok" not in evidence.columns:
            evidence = evidence.withColumn("second_ok", F.lit(True)).withColumn("model_check", F.lit("not tested"))
        matched = nearest_evidence(observed.filter("detector_ran").select("issue_key", "detected_rate"), evidence).drop("detected_rate")
        found = observed.join(matched, "issue_key", "left")
    risk = F.coalesce("material_risk", "risk")
    measured = F.col("repairability_status").isNotNull()
    passes = ((risk <= SAFE_MAX_RISK) & (F.col("repair_precision") >= SAFE_MIN_PRECISION)
              & (F.col("repairability_status") != "negative") & F.coalesce("second_ok", F.lit(True)))
    guarded = issue.isin(NEVER_AUTO)
    noisy = F.coalesce("underpowered", F.lit(False))
    borrowed = (F.col("source") == "published") & issue.isin(PROPOSAL_ONLY_WHEN_BORROWED)
    safe = F.coalesce(passes, F.lit(False)) & ~guarded & ~noisy & ~F.coalesce(borrowed, F.lit(False))
    flag_only = issue.isin(FLAG_ONLY)
    ran = F.col("detector_ran")
    safe = safe & ran & ~flag_only
    action = (F.when(~ran, "not assessed")
              .when(F.col("n_repair_candidates") + F.col("n_flag_only") == 0, "nothing to repair")
              .when(safe & (F.col("n_repair_candidates") > 0), "auto-repair").otherwise("flag for human review"))
    reason = (F.when(~ran, "detector did not run").when(flag_only, "there is no repair to apply")
              .when(~measured, "nothing measured").when(guarded, "a person always decides")
              .when(F.coalesce(passes, F.lit(False)) & noisy, "measured gain is within the noise")
              .when(F.coalesce(passes, F.lit(False)) & borrowed, "measured on other data only")
              .when(safe, "all safety limits hold").otherwise("a safety limit is broken"))
    return found.select(
        "issue_key", "detector_ran", "detected_rate", "n_repair_candidates", "n_flag_only",
        F.when(~ran, "not_assessed").when(flag_only, "flag_only").otherwise(F.coalesce("repairability_status", F.lit("unknown")))
        .alias("repairability_status"),
        F.when(ran & ~flag_only, risk).alias("benchmark_risk"),
        F.when(ran & ~flag_only, F.col("repair_precision")).alias("benchmark_repair_precision"),
        safe.alias("safe_auto"), action.alias("default_action"), F.coalesce("source", F.lit("-")).alias("evidence_source"),
        F.coalesce("model_check", F.lit("not tested")).alias("model_check"), reason.alias("reason"))


def auto_issues(policy: DataFrame) -> set[str]:
    """The issues the policy applies by itself (at most seven)."""
    return {row[0] for row in policy.filter("default_action = 'auto-repair'").select("issue_key").collect()}


# --- reports -----------------------------------------------------------------------------------------------------
def evidence_status(observed: DataFrame, tracking: DataFrame | None, published: dict[str, str]) -> DataFrame:
    """How far the flagged rate can be read as severity: measured here, else published, else not estimable."""
    fallback = F.coalesce(_map(published)[F.col("issue_key")], F.lit("not_estimable")) if published else F.lit("not_estimable")
    if tracking is None:
        return observed.withColumn("evidence_status", fallback)
    own = tracking.select(F.col("error_type").alias("issue_key"), F.col("evidence_status").alias("_own"))
    return observed.join(own, "issue_key", "left").withColumn("evidence_status", F.coalesce("_own", fallback)).drop("_own")


def quality_report(observed: DataFrame, reliability: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """One row per dimension: rate, count, unit, detector reliability and evidence status. `observed` adds detected_count."""
    kinds = _map({k: v[0] for k, v in DETECTOR_TYPES.items()})
    units = _map({k: v[1] for k, v in DETECTOR_TYPES.items()})
    out = observed.select(_map(DIMENSIONS)[F.col("issue_key")].alias("dimension"), "issue_key",
                          kinds[F.col("issue_key")].alias("detector_type"), "detected_rate", "detected_count",
                          units[F.col("issue_key")].alias("count_unit"), "detector_ran")
    if reliability is not None:
        scores = reliability.select(F.col("error_type").alias("issue_key"), F.col("precision").alias("benchmark_precision"),
                                    F.col("recall").alias("benchmark_recall"))
        out = out.join(scores, "issue_key", "left")
    else:
        out = out.withColumn("benchmark_precision", F.lit(None).cast("double")).withColumn("benchmark_recall", F.lit(None).cast("double"))
    if statuses is not None:
        out = out.join(statuses.select("issue_key", "evidence_status"), "issue_key", "left")
    else:
        out = out.withColumn("evidence_status", F.lit("not_estimable"))
    return out.withColumn("evidence_status", F.when(F.col("detector_ran"), F.col("evidence_status")).otherwise("not_run")).drop("detector_ran")


def impact_report(policy: DataFrame, estimates: DataFrame, second_estimates: DataFrame | None, disagreement: DataFrame | None,
                  applied: set[str]) -> DataFrame:
    """Policy rows with the damage estimate, a second metric, disagreement and what was decided."""
    out = policy.join(estimates.drop("detected_rate"), "issue_key", "left")
    if second_estimates is not None:
        out = out.join(second_estimates.select("issue_key", F.col("impact_estimate").alias("impact_estimate_second")), "issue_key", "left")
    else:
        out = out.withColumn("impact_estimate_second", F.lit(None).cast("double"))
    if disagreement is not None:
        out = out.join(disagreement.select(F.col("error_type").alias("issue_key"), F.col("disagree").alias("metrics_disagree")),
                       "issue_key", "left")
        out = out.withColumn("metrics_disagree", F.coalesce("metrics_disagree", F.lit(False)))
    else:
        out = out.withColumn("metrics_disagree", F.lit(False))
    was_applied = F.col("issue_key").isin(sorted(applied)) & (F.col("n_repair_candidates") > 0) if applied else F.lit(False)
    decision = (F.when(~F.col("detector_ran"), "not assessed")
                .when(was_applied & F.col("safe_auto"), "applied").when(was_applied, "applied (human override)")
                .when(F.col("n_repair_candidates") + F.col("n_flag_only") == 0, "nothing to repair")
                .otherwise("flagged for human review (not applied)"))
    advice = F.coalesce(_map(RECOMMENDATIONS)[F.col("repairability_status")], F.lit(RECOMMENDATIONS["unknown"]))
    return out.select("issue_key", "detected_rate", "impact_estimate", F.coalesce("is_boundary_estimate", F.lit(False)).alias(
        "is_boundary_estimate"), F.col("evidence_source").alias("impact_source"), "impact_estimate_second", "metrics_disagree",
        "repairability_status", "benchmark_risk", decision.alias("policy_decision"), advice.alias("recommendation"))


def readiness_status(rate: Column, floor: Column, status: Column) -> Column:
    return (F.when(status == "inverted", "High uncertainty").when(status == "not_estimable", "Evidence-limited")
            .when(floor.isNull(), "Unknown").when(rate > floor * 1.5 + 0.02, "Attention").otherwise("Good"))


def readiness_report(quality: DataFrame, floors: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Per dimension: observed rate, clean-data floor (0 for exact checks), status, rate after cleaning.
    `floors(issue_key, floor)`, `after(issue_key, rate_after_cleaning)`."""
    out = quality.join(floors, "issue_key", "left").withColumn(
        "floor", F.when(F.col("detector_type") == "exact check", 0.0).otherwise(F.col("floor")))
    ran = F.col("evidence_status") != "not_run"
    out = out.withColumn("status", F.when(ran, readiness_status(F.col("detected_rate"), F.col("floor"), F.col("evidence_status")))
                         .otherwise("Not assessed"))
    out = out.join(after, "issue_key", "left") if after is not None else out.withColumn("rate_after_cleaning", F.lit(None).cast("double"))
    return out.select("dimension", "issue_key", F.col("detected_rate").alias("observed_rate"),
                      F.col("floor").alias("baseline_false_positive_floor"), "evidence_status", "status", "rate_after_cleaning")


def quality_dimensions(rates: DataFrame) -> DataFrame:
    """Completeness, uniqueness and the like as one minus the detected rate (the anomaly burden stays a rate)."""
    return rates.select("issue_key", _map(DIMENSIONS)[F.col("issue_key")].alias("dimension"),
                        F.when(F.col("issue_key") == "outliers", F.col("detected_rate"))
                        .otherwise(1 - F.col("detected_rate")).alias("score"))
