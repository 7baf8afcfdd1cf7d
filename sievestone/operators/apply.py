"""Applying proposals: one writer per cell in a fixed order, a log row for every proposal, and the audit of that log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievestone.functions.columns import named
from sievestone.functions.hashing import draw
from sievestone.operators.overlay import overlay
from sievestone.operators.prepare import Prepared, kind_of
from sievestone.operators.propose import as_written
from sievestone.operators.ranks import hash_ranks
from sievestone.session import cut_lineage

# Fixed order in which issues write; the first writer of a cell wins.
APPLY_ORDER = ["inconsistency", "missing_values", "outliers", "feature_corruption", "label_errors", "duplicates"]
FLAG_ONLY = {"joint_outliers"}
AGGRESSIVE = set(APPLY_ORDER) - {"feature_corruption"}
REVIEW_ACTIONS = ["flagged_for_review", "flagged_only"]
LOG_COLUMNS = ["repair_id", "row_id", "issue_key", "column", "problem", "original_value", "proposed_value", "applied_value",
               "action", "method", "tier", "detector_score", "repair_evidence_status", "human_override"]


@dataclass
class Applied:
    """The cleaned table and its log, which is numbered (a pass over all proposals) when it is first read."""

    cleaned: DataFrame
    make_log: Callable[[], DataFrame]

    @cached_property
    def log(self) -> DataFrame:
        return self.make_log()


def decide_actions(proposals: DataFrame, issues: set[str], overrides: set[str] = frozenset(), hold_codes: bool = False,
                   out_of_scope: set[str] = frozenset()) -> DataFrame:
    """Adds `action` to every proposal.

    Cells of rows that will be dropped are skipped, a second writer of a cell is a conflict, and held-back repairs stay
    in review: columns the calibration did not cover, and cells that hold a code only the user can judge. Overridden
    issues are never held back. The per-cell window has a handful of rows per group.
    """
    order = F.array(*[F.lit(issue) for issue in APPLY_ORDER])
    rank = F.array_position(order, F.col("issue_key"))
    issue_in = lambda names: F.col("issue_key").isin(sorted(names)) if names else F.lit(False)
    free = issue_in(set(overrides))
    held = F.lit(False)
    if out_of_scope:
        held = held | (F.col("column").isin(sorted(out_of_scope)) & ~free & ~issue_in({"label_errors", "duplicates"}))
    if hold_codes:
        held = held | ((F.col("issue_key") == "missing_values") & F.col("read_as").isin("code", "word") & ~free)
    wanted = issue_in(issues) & F.col("tier").isin("exact", "strict") & ~F.coalesce(held, F.lit(False))
    marked = proposals.withColumn("_wanted", wanted).withColumn("_rank", rank)
    if "duplicates" in issues:
        dropped = proposals.filter("issue_key = 'duplicates' and tier in ('exact', 'strict')").select("row_id").distinct()
        marked = marked.join(dropped.withColumn("_dropped", F.lit(True)), "row_id", "left")
    else:
        marked = marked.withColumn("_dropped", F.lit(None).cast("boolean"))
    duplicate = F.col("issue_key") == "duplicates"
    writes = F.col("_wanted") & ~duplicate & F.col("_dropped").isNull()
    cell = W.partitionBy("row_id", "column", "_writes").orderBy("_rank", F.coalesce("method", F.lit("")))
    marked = marked.withColumn("_writes", writes).withColumn("_turn", F.row_number().over(cell))
    action = (
        F.when(F.col("_wanted") & duplicate, "applied")
        .when(F.col("_wanted") & F.col("_dropped").isNotNull(), "skipped_row_dropped")
        .when(F.col("_writes") & (F.col("_turn") == 1), "applied")
        .when(F.col("_writes"), "skipped_conflict")
        .when(F.col("tier") == "loose", "flagged_only").otherwise("flagged_for_review"))
    return marked.withColumn("action", action).drop("_wanted", "_rank", "_dropped", "_writes", "_turn")


def written_value(prepared: Prepared) -> "F.Column":
    """What lands in the file: text columns take ten significant digits, with a comma where the column uses one."""
    schema = {f.name: kind_of(f.dataType) for f in prepared.source.schema.fields}
    texts = sorted(c for c, kind in schema.items() if kind in ("text", "container"))
    number = F.col("proposed_number")
    as_text = as_written(number)
    commas = sorted(prepared.comma_columns)
    if commas:
        as_text = F.when(F.col("column").isin(commas), F.replace(as_text, F.lit("."), F.lit(","))).otherwise(as_text)
    in_text = F.col("column").isin(texts) if texts else F.lit(False)
    return (F.when(F.col("issue_key") == "duplicates", F.lit("row dropped"))
            .when(number.isNotNull() & in_text, as_text).otherwise(F.col("proposed_value")))


def apply_proposals(prepared: Prepared, proposals: DataFrame, issues: set[str], overrides: set[str] = frozenset(),
                    hold_codes: bool = False, out_of_scope: set[str] = frozenset(), policy: DataFrame | None = None) -> Applied:
    """The cleaned table and its log. Detection is not repeated: everything comes from `proposals`."""
    decided = decide_actions(proposals, issues, overrides, hold_codes, out_of_scope)
    decided = cut_lineage(decided.withColumn("applied_value", F.when(F.col("action") == "applied", written_value(prepared))))  # read by drops, changes and log
    changes = decided.filter("action = 'applied' and issue_key <> 'duplicates'").select(
        "row_id", "column", F.col("applied_value").alias("value"))
    types = {}
    if prepared.target and prepared.task == "regression" and "label_errors" in issues:
        types[prepared.target] = "double"
    columns = prepared.numbers + prepared.texts + ([prepared.target] if prepared.target else [])
    kept = prepared.source
    if "duplicates" in issues:
        gone = decided.filter("action = 'applied' and issue_key = 'duplicates'").select(
            F.col("row_id").alias("_gone")).distinct()
        kept = kept.join(gone, named(prepared.row_id) == F.col("_gone"), "left_anti")
    cleaned = overlay(kept, prepared.row_id, changes, types=types, columns=columns)
    if policy is not None:
        status = policy.select("issue_key", F.col("repairability_status").alias("repair_evidence_status"))
        decided = decided.join(F.broadcast(status), "issue_key", "left")  # one row per issue
    else:
        decided = decided.withColumn("repair_evidence_status", F.lit(None).cast("string"))
    overridden = F.col("issue_key").isin(sorted(overrides)) if overrides else F.lit(False)
    hashed = decided.withColumn("human_override", overridden & (F.col("action") == "applied")).withColumn(
        "_h", draw("repair", F.col("issue_key"), F.col("row_id"), F.coalesce("column", F.lit("")), F.coalesce("method", F.lit(""))))


    def log() -> DataFrame:
        numbered = hash_ranks(hashed, "_h", "_number").withColumn("repair_id", F.format_string("R%06d", F.col("_number").cast("long")))
        return numbered.select(*LOG_COLUMNS)

    return Applied(cleaned, log)


# --- views of the log --------------------------------------------------------------------------------------------
def review_worklist(log: DataFrame) -> DataFrame:
    return log.filter(F.col("action").isin(REVIEW_ACTIONS))


def review_summary(log: DataFrame) -> DataFrame:
    return review_worklist(log).groupBy("issue_key", "problem").agg(
        F.count_if(F.col("action") == "flagged_for_review").alias("proposed"),
        F.count_if(F.col("action") == "flagged_only").alias("flag_only"))


def log_page(log: DataFrame, action: str | None = None, issue: str | None = None, offset: int = 0, size: int = 50) -> DataFrame:
    """One page of the log in id order."""
    view = log
    if action:
        view = view.filter(F.col("action") == action)
    if issue:
        view = view.filter(F.col("issue_key") == issue)
    return view.orderBy("repair_id").offset(offset).limit(size)


def held_back(proposals: DataFrame, log: DataFrame, out_of_scope: set[str]) -> DataFrame:
    """Review items of auto-applied issues per column and reason: outside the calibration, or a code."""
    reasons = proposals.select("issue_key", "row_id", "column", "read_as").join(
        log.filter("action = 'flagged_for_review'").select("issue_key", "row_id", "column"), ["issue_key", "row_id", "column"], "left_semi")
    outside = F.col("column").isin(sorted(out_of_scope)) if out_of_scope else F.lit(False)
    reason = F.when(outside, "calibration").when(
        (F.col("issue_key") == "missing_values") & F.col("read_as").isin("code", "word"), "codes")
    return (reasons.filter(~F.col("issue_key").isin("label_errors", "duplicates")).withColumn("reason", reason)
            .filter("reason is not null").groupBy("issue_key", "column", "reason").agg(F.count(F.lit(1)).alias("cells")))


def run_summary(source: DataFrame, applied: Applied) -> DataFrame:
    """Rows before and after, cells modified and log rows per action, as metric/value rows."""
    before = source.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows_uploaded").alias("metric"), "value")
    after = applied.cleaned.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows_after_cleaning").alias("metric"), "value")
    cells_changed = applied.log.filter("action = 'applied' and issue_key <> 'duplicates'").agg(
        F.count(F.lit(1)).alias("value")).select(F.lit("cells_modified").alias("metric"), "value")
    actions = applied.log.groupBy("action").agg(F.count(F.lit(1)).alias("value")).select(F.col("action").alias("metric"), "value")
    return before.unionByName(after).unionByName(cells_changed).unionByName(actions)


# --- auditing the log --------------------------------------------------------------------------------------------
def changed_cells(before: DataFrame, after: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id, column, old, new of cells that differ between two versions; one join on the unique id, then in-row tests."""
    old = before.select(named(row_id).alias("row_id"), F.struct(*[named(c).cast("string").alias(c) for c in columns]).alias("old"))
    new = after.select(named(row_id).alias("row_id"), F.struct(*[named(c).cast("string").alias(c) for c in columns]).alias("new"))
    items = [F.when(~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.struct(
        F.lit(c).alias("column"), F.col("old")[c].alias("old"), F.col("new")[c].alias("new"))) for c in columns]
    return old.join(new, "row_id").select("row_id", F.explode(
        F.filter(F.array(*items), lambda x: x.isNotNull())).alias("c")).select("row_id", "c.*")


def audit_log(source: DataFrame, applied: Applied, row_id: str, columns: list[str]) -> DataFrame:
    """Counts that must all be zero: changes without a log row, logged values that are not in the file, rows dropped
    without a log row, logged drops still in the file."""
    writes = applied.log.filter("action = 'applied' and issue_key <> 'duplicates'").select("row_id", "column", "applied_value")
    drops = applied.log.filter("action = 'applied' and issue_key = 'duplicates'").select("row_id")
    changed = changed_cells(source, applied.cleaned, row_id, columns)
    unlogged = changed.join(writes, ["row_id", "column"], "left_anti")
    stored = applied.cleaned.select(named(row_id).alias("row_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("stored")) for c in columns])).alias("c")).select(
        "row_id", "c.*")
    differs = ~(F.col("stored").eqNullSafe(F.col("applied_value")) | F.coalesce(
        F.col("stored").try_cast("double") == F.col("applied_value").try_cast("double"), F.lit(False)))
    wrong = writes.join(stored, ["row_id", "column"]).filter(differs)
    ids = lambda frame: frame.select(named(row_id).alias("row_id"))
    gone = ids(source).join(ids(applied.cleaned), "row_id", "left_anti")
    checks = {
        "changed_without_log": unlogged, "logged_value_not_stored": wrong,
        "dropped_without_log": gone.join(drops, "row_id", "left_anti"),
        "logged_drop_still_present": drops.join(ids(applied.cleaned), "row_id", "left_semi"),
    }
    result = None
    for name, frame in checks.items():
        row = frame.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        result = row if result is None else result.unionByName(row)
    return result


def spot_check(log: DataFrame, per_problem: int = 20, seed: int = 0) -> DataFrame:
    """Up to `per_problem` random log rows per problem: a report for human eyes. Each task keeps its own best rows first,
    so a problem that fills the log is never sorted in one place."""
    hashed = log.withColumn("_h", draw(seed, F.col("repair_id"))).withColumn("_part", F.substring("_h", 1, 2))
    local = W.partitionBy("problem", "_part").orderBy("_h")
    final = W.partitionBy("problem").orderBy("_h")
    few = hashed.withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= per_problem)
    return few.withColumn("_n", F.row_number().over(final)).filter(F.col("_n") <= per_problem).drop("_h", "_part", "_n")


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 2e-3, skip=()) -> DataFrame:
    """Differences between two tables with the same key: missing rows and cells that differ beyond the tolerance."""
    columns = [c for c in left.columns if c not in keys and c not in skip]
    a = left.select(*keys, F.struct(*[named(c).cast("string").alias(c) for c in columns]).alias("a"))
    b = right.select(*keys, F.struct(*[named(c).cast("string").alias(c) for c in columns]).alias("b"))
    items = []
    for c in columns:
        x, y = F.col("a")[c], F.col("b")[c]
        close = F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) <= tolerance, F.lit(False))
        items.append(F.when(~x.eqNullSafe(y) & ~close, F.struct(F.lit(c).alias("column"), x.alias("left"), y.alias("right"))))
    lone = F.array(F.struct(F.lit("*row*").alias("column"), F.when(F.col("a").isNotNull(), "present").alias("left"),
                            F.when(F.col("b").isNotNull(), "present").alias("right")))
    found = F.when(F.col("a").isNull() | F.col("b").isNull(), lone).otherwise(
        F.filter(F.array(*items), lambda x: x.isNotNull()))
    return a.join(b, keys, "full").select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


# --- truth-based repairs -----------------------------------------------------------------------------------------
def oracle_repair(dirty: DataFrame, row_id: str, log: DataFrame, columns: list[str]) -> DataFrame:
    """Undo exactly what the truth log records: restore originals, drop appended copies. When several injectors hit one
    cell (a log with `step`), the earliest entry holds its original."""
    copies = log.filter("error_type = 'duplicates'").select(F.col("row_id").alias("_copy"))
    step = F.col("step") if "step" in log.columns else F.lit(0)
    cell_log = log.filter("error_type <> 'duplicates'").groupBy("row_id", "column").agg(
        F.min_by(F.struct("original_value"), step)["original_value"].alias("value"))
    kept = dirty.join(copies, named(row_id) == F.col("_copy"), "left_anti")
    return overlay(kept, row_id, cell_log, columns=columns)


def partial_restore(dirty: DataFrame, row_id: str, log: DataFrame, columns: list[str], kinds: set[str] | None = None,
                    portion: float | None = None, seed: int = 0) -> DataFrame:
    """Restore only the chosen kinds of injected cells, or a random portion of them."""
    from sievestone.functions.hashing import draw_unit

    chosen = log
    if kinds is not None:
        chosen = chosen.filter(F.col("kind").isin(sorted(kinds)))
    if portion is not None:
        chosen = chosen.filter(draw_unit(draw(seed, F.col("row_id"), F.col("column"))) < portion)
    return oracle_repair(dirty, row_id, chosen, columns)

