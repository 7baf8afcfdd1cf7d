"""Grading against known truth, and the evidence built from repeated runs.

Key sets can be as large as the data and are joined on their keys. Run and evidence tables hold one row per
(issue, rate, seed) and are aggregated with plain group-bys.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed parameters of the evidence rules.
NOISE_FLOOR = 0.003
SIGN_AGREEMENT = 0.8
MAX_CERTIFIABLE_FLOOR = 0.01
SAFE_MIN_PRECISION = 0.95
SAFE_MAX_RISK = 1e-9
INFORMATIVE_DAMAGE = 0.005
WEIGHTS = (0.2, 0.3, 0.4, 0.5, 0.6)
# Fixed assumption: relative cleaning effort per issue.
EFFORT = {"duplicates": 1.0, "outliers": 3.0, "missing_values": 3.0, "label_errors": 8.0, "feature_corruption": 9.0}


# --- key sets ----------------------------------------------------------------------------------------------------
def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str], empty: float | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two key sets. `empty` is what a ratio over nothing gives: null in
    calibration, 0 in research grading. One full join on the keys; keys are unique, so none is hot."""
    a = truth.select(*keys).distinct().withColumn("_true", F.lit(1))
    b = found.select(*keys).distinct().withColumn("_found", F.lit(1))
    both = a.join(b, keys, "full").agg(
        F.count_if(F.col("_true").isNotNull() & F.col("_found").isNotNull()).alias("tp"),
        F.count_if(F.col("_true").isNull()).alias("fp"), F.count_if(F.col("_found").isNull()).alias("fn"))
    fallback = F.lit(empty).cast("double")
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(fallback)
    scored = both.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(fallback))


def values_close(true: Column, got: Column) -> Column:
    """Restored well enough: equal text, or a number within 10% (within 1e-6 of a true zero)."""
    a, b = true.try_cast("double"), got.try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    near = F.when(a == 0, F.abs(b) < 1e-6).otherwise(F.abs(b - a) / F.abs(a) < 0.10)
    return F.when(true.isNull() | got.isNull(), False).when(numeric, near).otherwise(true == got)


def grade_repair(log: DataFrame, repaired: DataFrame, keys: list[str]) -> DataFrame:
    """Which cells were touched, and of the right ones how many got their value back. `repaired` holds the keys and the
    value now stored (`repaired_value`); a repair that only drops rows passes the value 'row dropped'."""
    truth = log.select(*keys, F.col("original_value").alias("_true_value")).withColumn("_t", F.lit(1))
    touched = repaired.select(*keys, F.col("repaired_value").alias("_new_value")).withColumn("_r", F.lit(1))
    joined = truth.join(touched, keys, "full")
    hit = F.col("_t").isNotNull() & F.col("_r").isNotNull()
    restored = hit & ((F.col("_new_value") == "row dropped") | values_close(F.col("_true_value"), F.col("_new_value")))
    counts = joined.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"),
                        F.count_if(F.col("_r").isNull()).alias("fn"),
                        F.count_if(F.coalesce(restored, F.lit(False))).alias("restored_correctly"))
    zero = F.lit(0.0)
    return counts.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(zero)) \
        .withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(zero))


def grade_by_kind(log: DataFrame, flagged: DataFrame, repaired: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Per injected kind: cells, flagged, correctly repaired, and both as recall."""
    marked = (log.select(*keys, kind, "original_value")
              .join(flagged.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "left")
              .join(repaired.select(*keys, F.col("repaired_value").alias("_v")), keys, "left"))
    return marked.groupBy(kind).agg(
        F.count(F.lit(1)).alias("injected"), F.count("_f").alias("flagged"),
        F.count_if(F.col("_v") == F.col("original_value")).alias("repaired_correctly")).select(
        kind, "injected", "flagged", "repaired_correctly",
        (F.col("flagged") / F.col("injected")).alias("flag_recall"),
        (F.col("repaired_correctly") / F.col("injected")).alias("repair_recall"))


# --- runs to evidence --------------------------------------------------------------------------------------------
def with_recovery(runs: DataFrame) -> DataFrame:
    """Adds damage, recovery and the two recovery rates to clean / dirty / repaired / oracle scores of a run."""
    damage, recovery = F.col("clean") - F.col("dirty"), F.col("repaired") - F.col("dirty")
    out = runs.withColumn("damage", damage).withColumn("recovery", recovery).withColumn(
        "recovery_rate_vs_clean", F.when(F.abs(damage) > 1e-9, recovery / damage))
    if "oracle" in runs.columns:
        best = F.col("oracle") - F.col("dirty")
        out = out.withColumn("recovery_rate_vs_oracle", F.when(F.abs(best) > 1e-9, recovery / best))
    return out


def summarise_runs(runs: DataFrame, values: list[str]) -> DataFrame:
    """Mean, sample deviation and number of seeds per (issue, rate)."""
    return runs.groupBy("issue", "rate").agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values], *[F.stddev_samp(v).alias(f"std_{v}") for v in values],
        F.count_distinct("seed").alias("n_seeds"))


def status_of(agreement: Column, mean: Column, floor: Column) -> Column:
    """positive / negative when most seeds agree on the sign and the mean clears the floor, else weak."""
    clear = agreement >= SIGN_AGREEMENT
    return F.when(clear & (mean >= floor), "positive").when(clear & (mean <= -floor), "negative").otherwise("weak")


def sign_agreement(value: Column) -> Column:
    return F.greatest(F.count_if(value > 0), F.count_if(value < 0)) / F.count(value)


def harm(value: Column, beyond: Column) -> tuple[Column, Column, Column]:
    """(probability, mean size, product) of a value falling below -beyond."""
    bad = value < -beyond
    p = F.count_if(bad) / F.count(value)
    size = F.coalesce(F.abs(F.avg(F.when(bad, value))), F.lit(0.0))
    return p, size, p * size


def evidence_table(runs: DataFrame, floor: float = NOISE_FLOOR, damage: str = "damage", recovery: str = "recovery") -> DataFrame:
    """One row per (issue, rate): damage, recovery, repair grading, status, harm and material harm.

    A repair that restores the clean table exactly is never harmful: its status is positive or weak, its material risk 0.
    """
    d, r, level = F.col(damage), F.col(recovery), F.lit(float(floor))
    exact = F.bool_and("restored_exactly")
    p_harm, size, risk = harm(r, F.lit(0.0))
    material = (r < -level) & ~F.col("restored_exactly")
    p_material = F.count_if(material) / F.count(r)
    material_risk = p_material * F.coalesce(F.abs(F.avg(F.when(material, r))), F.lit(0.0))
    exact_status = F.when((F.count_if(d > 0) / F.count(d) >= SIGN_AGREEMENT) & (F.avg(d) >= level), "positive").otherwise("weak")
    table = runs.groupBy(F.col("issue").alias("error_type"), "rate").agg(
        F.avg(d).alias("mean_damage"), F.stddev_samp(d).alias("damage_std"),
        F.avg("repair_precision").alias("repair_precision"), F.avg("repair_recall").alias("repair_recall"),
        F.avg(r).alias("mean_recovery"), sign_agreement(r).alias("sign_agreement"),
        F.count_if(r > 0).alias("n_pos_seeds"), F.count_if(r < 0).alias("n_neg_seeds"),
        F.when(exact, exact_status).otherwise(status_of(sign_agreement(r), F.avg(r), level)).alias("repairability_status"),
        p_harm.alias("p_harm"), size.alias("harm_magnitude"), risk.alias("risk"),
        F.when(exact, 0.0).otherwise(p_material).alias("p_material_harm"),
        F.when(exact, 0.0).otherwise(material_risk).alias("material_risk"), exact.alias("restored_exactly"))
    return table.withColumn("evidence_status", F.when(F.col("repairability_status") == "weak", "partial").otherwise("complete"))


def evidence_from_tables(impact: DataFrame, repair_runs: DataFrame, floor: float = NOISE_FLOOR) -> DataFrame:
    """The same table from a damage summary (error_type, rate, mean_damage, std_damage) and raw repair runs."""
    r, level = F.col("recovery"), F.lit(float(floor))
    p_harm, size, risk = harm(r, F.lit(0.0))
    repaired = repair_runs.groupBy(F.col("issue").alias("error_type"), "rate").agg(
        F.avg("repair_precision").alias("repair_precision"), F.avg("repair_recall").alias("repair_recall"),
        F.avg(r).alias("mean_recovery"), sign_agreement(r).alias("sign_agreement"),
        F.count_if(r > 0).alias("n_pos_seeds"), F.count_if(r < 0).alias("n_neg_seeds"),
        status_of(sign_agreement(r), F.avg(r), level).alias("repairability_status"),
        p_harm.alias("p_harm"), size.alias("harm_magnitude"), risk.alias("risk"))
    return repaired.join(impact, ["error_type", "rate"]).withColumn(
        "evidence_status", F.when(F.col("repairability_status") == "weak", "partial").otherwise("complete"))


def stricter(a: Column, b: Column) -> Column:
    return (F.when((a == "negative") | (b == "negative"), "negative")
            .when((a == "positive") & (b == "positive"), "positive").otherwise("weak"))


def is_safe(risk: Column, precision: Column, status: Column) -> Column:
    return (risk <= SAFE_MAX_RISK) & (precision >= SAFE_MIN_PRECISION) & (status != "negative")


def combine_evidence(first: DataFrame, second: DataFrame | None, floor: float, second_floor: float | None) -> DataFrame:
    """Two metrics in one table: the stricter status, the larger risk, and a power guard on noisy calibrations."""
    out = first.withColumn("status_first", F.col("repairability_status")).withColumn("material_risk_first", F.col("material_risk"))
    worst = floor
    if second is None:
        out = (out.withColumn("status_second", F.col("status_first")).withColumn("material_risk_second", F.lit(None).cast("double")))
    else:
        worst = max(floor, second_floor)
        other = second.select("error_type", "rate", F.col("repairability_status").alias("status_second"),
                              F.col("mean_damage").alias("mean_damage_second"), F.col("mean_recovery").alias("mean_recovery_second"),
                              F.col("material_risk").alias("material_risk_second"), F.col("p_material_harm").alias("_p2"))
        out = out.join(other, ["error_type", "rate"], "left")
        out = (out.withColumn("p_material_harm", F.greatest("p_material_harm", "_p2")).drop("_p2")
               .withColumn("material_risk", F.greatest("material_risk_first", "material_risk_second"))
               .withColumn("repairability_status", stricter(F.col("status_first"), F.col("status_second"))))
        out = out.withColumn("evidence_status", F.when(F.col("repairability_status") == "weak", "partial").otherwise("complete"))
    return out.withColumn("noise_floor", F.lit(worst)).withColumn(
        "underpowered", F.lit(worst > MAX_CERTIFIABLE_FLOOR) & ~F.col("restored_exactly"))


def second_model_evidence(runs: DataFrame, floor: float, first: DataFrame) -> DataFrame:
    """Evidence under a second model next to the first: agreement, effective status, safe under both, harm only here."""
    second = evidence_table(runs.withColumn("restored_exactly", F.lit(False)), floor).drop("restored_exactly")
    other = first.select("error_type", "rate", F.col("repairability_status").alias("first_status"),
                         F.col("risk").alias("first_risk"), F.col("repair_precision").alias("first_precision"))
    out = second.join(other, ["error_type", "rate"], "left")
    mine, theirs = F.col("repairability_status"), F.col("first_status")
    out = out.withColumn("status_agrees", mine == theirs).withColumn("effective_status", stricter(mine, theirs))
    out = out.withColumn("second_safe", is_safe(F.col("risk"), F.col("repair_precision"), mine)).withColumn(
        "first_safe", is_safe(F.col("first_risk"), F.col("first_precision"), theirs))
    return out.withColumn("safe_under_both", F.col("second_safe") & F.col("first_safe")).withColumn(
        "second_only_harm", theirs.isin("positive", "weak") & (mine == "negative"))


def metric_disagreement(curve: DataFrame, floor: float, second_floor: float) -> DataFrame:
    """Issues where one metric shows damage and the other none at a majority of the rates."""
    a, b = F.col("mean_damage"), F.col("mean_damage_second")
    first_hides, second_hides = (a <= 0) & (b >= second_floor), (b <= 0) & (a >= floor)
    counted = curve.groupBy("error_type").agg(F.count_if(first_hides).alias("first_hides"),
                                              F.count_if(second_hides).alias("second_hides"), F.count(F.lit(1)).alias("rates"))
    return counted.filter((F.col("first_hides") * 2 > F.col("rates")) | (F.col("second_hides") * 2 > F.col("rates"))).select(
        "error_type", F.lit(True).alias("disagree"),
        F.when(F.col("first_hides") >= F.col("second_hides"), "first metric hides damage")
        .otherwise("second metric hides damage").alias("note"))


def mean_rank(value: str, group: list[str]) -> Column:
    """Average rank inside a small group, ties sharing theirs."""
    order = W.partitionBy(*group).orderBy(value)
    ties = W.partitionBy(*group, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def tracking_table(runs: DataFrame, floor: float, damage: str = "damage") -> DataFrame:
    """Does the flagged rate follow the measured damage? Pearson and Spearman over the rates of each issue."""
    points = runs.groupBy("issue", "rate").agg(F.avg("detected_rate").alias("det"), F.avg(damage).alias("dmg"))
    ranked = points.withColumn("det_rank", mean_rank("det", ["issue"])).withColumn("dmg_rank", mean_rank("dmg", ["issue"]))
    stats = ranked.groupBy(F.col("issue").alias("error_type")).agg(
        F.count(F.lit(1)).alias("n_points"), F.stddev_samp("det").alias("det_sd"), F.stddev_samp("dmg").alias("dmg_sd"),
        F.max(F.abs("dmg")).alias("top"), F.corr("det", "dmg").alias("r"), F.corr("det_rank", "dmg_rank").alias("rho"))
    blind = ((F.col("n_points") < 3) | (F.col("det_sd") < 1e-9) | (F.col("top") < floor) | (F.col("dmg_sd") < 1e-12))
    return stats.select(
        "error_type", "n_points", F.when(~blind, F.col("r")).alias("pearson_r"), F.when(~blind, F.col("rho")).alias("spearman_r"),
        F.when(blind, "not_estimable").when(F.col("r") <= -0.8, "inverted").otherwise("weak").alias("evidence_status"))


def worst_tracking(first: DataFrame, second: DataFrame) -> DataFrame:
    """The more worrying verdict of two metrics: inverted, then weak, then not estimable."""
    level = lambda c: F.when(c == "inverted", 3).when(c == "weak", 2).otherwise(1)
    other = second.select("error_type", F.col("evidence_status").alias("_other"), F.col("pearson_r").alias("pearson_r_second"))
    joined = first.join(other, "error_type", "left")
    return joined.withColumn("evidence_status", F.when(
        level(F.col("_other")) > level(F.col("evidence_status")), F.col("_other")).otherwise(F.col("evidence_status"))).drop("_other")


# --- priorities --------------------------------------------------------------------------------------------------
def min_max(value: str, group: list[str]) -> Column:
    """0..1 within the group, 0.5 when all are equal. Nulls stay null."""
    over = W.partitionBy(*group)
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(F.col(value).isNull(), None).when(high - low < 1e-12, 0.5).otherwise((F.col(value) - low) / (high - low))


def priorities(evidence: DataFrame, impact: Column | float, risk: Column | float, repair: Column | float, group=("rate",)) -> DataFrame:
    """Impact minus risk plus repairability, scaled within a rate; the repair term is dropped where nothing is known."""
    keys = list(group)
    wi, wr, wp = (w if isinstance(w, Column) else F.lit(float(w)) for w in (impact, risk, repair))
    known = evidence.withColumn("_rec", F.when(F.col("repairability_status") != "not_estimable", F.col("mean_recovery")))
    scaled = (known.withColumn("impact_norm", min_max("mean_damage", keys)).withColumn("risk_norm", min_max("risk", keys))
              .withColumn("repairability_norm", min_max("_rec", keys)).drop("_rec"))
    total = wi + wr
    half = F.lit(0.5)
    short = (F.when(total > 0, wi / total).otherwise(half) * F.col("impact_norm")
             - F.when(total > 0, wr / total).otherwise(half) * F.col("risk_norm"))
    full = wi * F.col("impact_norm") - wr * F.col("risk_norm") + wp * F.col("repairability_norm")
    return scaled.withColumn("priority_score", F.when(F.col("repairability_norm").isNull(), short).otherwise(full))


def sensitivity(evidence: DataFrame, rate: float, weights=WEIGHTS) -> DataFrame:
    """Rank of each issue over every weight triple that sums to one (15 triples, fixed)."""
    triples = [t for t in itertools.product(weights, repeat=3) if abs(sum(t) - 1) < 1e-9]
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(a).alias("wi"), F.lit(b).alias("wr"), F.lit(c).alias("wp"))
                               for i, (a, b, c) in enumerate(triples)]))
    at_rate = evidence.filter(F.abs(F.col("rate") - rate) < 1e-9).select("*", grid.alias("g")).select("*", "g.*").drop("g")
    scored = priorities(at_rate, F.col("wi"), F.col("wr"), F.col("wp"), group=("combo",))
    ranked = scored.withColumn("score", F.round("priority_score", 9)).withColumn(
        "place", F.row_number().over(W.partitionBy("combo").orderBy(F.desc("score"), "error_type")))
    return ranked.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n_weight_combos"), F.avg("place").alias("mean_rank"), F.min("place").alias("min_rank"),
        F.max("place").alias("max_rank"), (F.count_if(F.col("place") == 1) / F.count(F.lit(1))).alias("rank_1_pct"),
        (F.max("place") - F.min("place") <= 1).alias("rank_stable"))


def effort_priority(impacts: DataFrame, effort: dict[str, float] = EFFORT) -> DataFrame:
    """Impact per unit of effort, highest first."""
    cost = F.create_map(*[F.lit(x) for pair in effort.items() for x in pair])
    return impacts.withColumn("effort", cost[F.col("error_type")]).withColumn(
        "priority", F.col("mean_damage") / (F.col("effort") + 1e-6))


def readiness_ratio(clean: Column, dirty: Column, repaired: Column) -> tuple[Column, Column]:
    """(share of the gap recovered, verdict)."""
    gap = clean - dirty
    ratio = F.when(gap <= 0, 1.0).otherwise((repaired - dirty) / gap)
    return ratio, F.when(ratio >= 0.9, "ready").when(ratio >= 0.5, "partially ready").otherwise("not ready")


def compare_damage(second: DataFrame, first: DataFrame) -> DataFrame:
    """Damage under two models per (issue, rate): ratio where the first is informative, and the top issue per rate."""
    a = first.select("error_type", "rate", F.col("mean_damage").alias("first_damage"))
    joined = second.select("error_type", "rate", F.col("mean_damage").alias("second_damage")).join(a, ["error_type", "rate"])
    informative = F.col("first_damage") >= INFORMATIVE_DAMAGE
    per_rate = W.partitionBy("rate")
    return joined.withColumn("informative", informative).withColumn(
        "ratio", F.when(informative, F.col("second_damage") / F.col("first_damage"))).withColumn(
        "top_first", F.max_by("error_type", "first_damage").over(per_rate)).withColumn(
        "top_second", F.max_by("error_type", "second_damage").over(per_rate))


def damage_agreement(compared: DataFrame) -> DataFrame:
    """Spearman over all cells and the median ratio over the informative ones (a table of issue x rate cells)."""
    ranked = compared.withColumn("_g", F.lit(0)).withColumn("x", mean_rank("first_damage", ["_g"])).withColumn(
        "y", mean_rank("second_damage", ["_g"]))
    return ranked.agg(F.count(F.lit(1)).alias("n_cells"), F.corr("x", "y").alias("spearman"),
                      F.count("ratio").alias("n_informative"), F.percentile("ratio", 0.5).alias("median_ratio"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed agreement, chance agreement and Cohen's kappa of two categorical columns, from their pair counts."""
    pairs = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    left = pairs.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = pairs.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    expected = left.join(right, "v").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    seen = pairs.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    both = seen.join(F.broadcast(expected))  # one row each
    observed, chance = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", observed.alias("observed"), chance.alias("chance"),
                       F.when(chance < 1, (observed - chance) / (1 - chance)).alias("kappa"))


def damage_grid(curve: DataFrame, rates=(0.05, 0.1, 0.2)) -> DataFrame:
    """Issues as rows, rates as columns."""
    return curve.groupBy("error_type").pivot("rate", list(rates)).agg(F.avg("mean_damage"))
