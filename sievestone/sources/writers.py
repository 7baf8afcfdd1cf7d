"""Writers: every output table of a run in its own folder, the review worklist, and the log of model fits."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from sievestone.operators.apply import review_worklist
from sievestone.plans.audit import Audit, Repaired


def write_tables(tables: dict[str, DataFrame | None], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """Each table written in parallel by its own tasks; nothing is collected. Returns the names written."""
    written = []
    for name, table in tables.items():
        if table is None:
            continue
        writer = table.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{folder}/{name}")
        written.append(name)
    return written


def write_outputs(state: Audit, result: Repaired, folder: str, fmt: str = "parquet") -> list[str]:
    """Both cleaned tables, both logs, the reports, the policy, the calibration and the feature report."""
    calibration = state.calibration
    return write_tables({
        "cleaned": result.cleaned, "cleaned_aggressive": result.aggressive.cleaned, "repair_log": result.log,
        "repair_log_aggressive": result.aggressive.log, "quality_report": result.quality, "impact_report": result.impact,
        "readiness_report": result.readiness, "policy": state.policy, "review_worklist": review_worklist(result.log),
        "calibration_evidence": getattr(calibration, "evidence", None), "calibration_runs": getattr(calibration, "runs", None),
        "feature_report": state.feature_report}, folder, fmt)


def append_fit_log(spark: SparkSession, folder: str, stage: str, model: str, parameters: str, rows: int, seconds: float) -> None:
    """One row per model fit, appended."""
    row = (datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), stage, model, parameters, rows, seconds)
    spark.createDataFrame([row], "at timestamp, stage string, model string, parameters string, n_rows long, seconds double").write.mode("append").parquet(folder)
