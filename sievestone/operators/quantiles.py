"""Exact linear-interpolated quantiles of many columns at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_TASK_ROWS = 100_000  # up to here the built-in percentile (one map of distinct values per column) is quick and safe
BUCKETS = 2048          # buckets per refinement step
COLLECT_ROWS = 100_000  # rows left in all open intervals before their distinct values are read directly


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], in_task_rows: int | None = None) -> dict:
    """{name: [quantile, ...]} for {name: (expression, [probabilities])}; null and NaN are left out.

    Small inputs use `percentile`. That aggregate ends in one task holding every distinct value, so larger inputs
    are refined instead: count equal-width buckets between the smallest and largest value, keep the bucket that
    holds the wanted rank, repeat inside it. Each step is one scan with map-side combining and returns at most
    BUCKETS rows per open interval; the result is the same order statistic, not an approximation.
    """
    limit = IN_TASK_ROWS if in_task_rows is None else in_task_rows
    names = list(wanted)
    if not names:
        return {}
    slim = df.select(*[wanted[name][0].cast("double").alias(f"v{i}") for i, name in enumerate(names)])
    slim = slim.select(*[F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")).alias(f"v{i}") for i in range(len(names))])
    finite = lambda i: F.when(F.abs(f"v{i}") < math.inf, F.col(f"v{i}"))
    size = slim.agg(*[e for i in range(len(names)) for e in (
        F.count(f"v{i}").alias(f"n{i}"), F.min(finite(i)).alias(f"lo{i}"), F.max(finite(i)).alias(f"hi{i}"),
        F.count_if(F.col(f"v{i}") == -math.inf).alias(f"below{i}"), F.count_if(F.col(f"v{i}") == math.inf).alias(f"above{i}"))]).first()
    if max(size[f"n{i}"] for i in range(len(names))) <= limit:
        row = slim.agg(*[F.percentile(f"v{i}", list(wanted[name][1])).alias(f"q{i}")
                         for i, name in enumerate(names)]).first()
        return {name: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(wanted[name][1])
                for i, name in enumerate(names)}
    targets, infinite = {}, {}
    for i, name in enumerate(names):
        count, below, above = size[f"n{i}"], size[f"below{i}"], size[f"above{i}"]
        for p in wanted[name][1] if count else []:
            position = p * (count - 1)
            for k in {math.floor(position), math.ceil(position)}:
                if below <= k < count - above:
                    targets[(i, k)] = (size[f"lo{i}"], size[f"hi{i}"], below)
                else:
                    infinite[(i, k)] = -math.inf if k < below else math.inf
    found = _order_statistics(slim, targets) | infinite
    result = {}
    for i, name in enumerate(names):
        count = size[f"n{i}"]
        values = []
        for p in wanted[name][1]:
            if not count:
                values.append(None)
                continue
            position = p * (count - 1)
            low, high = found[(i, math.floor(position))], found[(i, math.ceil(position))]
            values.append(low if low == high else low + (high - low) * (position - math.floor(position)))
        result[name] = values
    return result


def _order_statistics(slim: DataFrame, targets: dict) -> dict:
    """The k-th smallest value (0-based) of column i for each target (i, k)."""
    found, inside = {}, None
    while targets:
        for key in [key for key, (lo, hi, _) in targets.items() if lo == hi]:
            found[key] = targets.pop(key)[0]
        if not targets:
            break
        intervals = sorted({(i, lo, hi) for (i, _), (lo, hi, _) in targets.items()})
        finish = inside is not None and sum(inside[interval] for interval in intervals) <= COLLECT_ROWS
        counted = _bucket_counts(slim, intervals, finish)
        number_of = {interval: number for number, interval in enumerate(intervals)}
        inside = {}
        for (i, k), (lo, hi, before) in list(targets.items()):
            for row in counted[number_of[(i, lo, hi)]]:
                if k < before + row["n"]:
                    targets[(i, k)] = (row["lo"], row["hi"], before)
                    inside[(i, row["lo"], row["hi"])] = row["n"]
                    break
                before += row["n"]
    return found


def _bucket_counts(slim: DataFrame, intervals: list[tuple], finish: bool) -> dict[int, list]:
    """Rows per bucket of each open interval, in value order; per distinct value when `finish`. The intervals of a column
    do not overlap, so each cell falls into at most one."""
    chains: dict[int, list[str]] = {}
    for number, (i, lo, hi) in enumerate(intervals):
        width = hi / BUCKETS - lo / BUCKETS if math.isinf(hi - lo) else (hi - lo) / BUCKETS
        place = f"v{i} / {width!r}D - {lo / width!r}D" if math.isinf(hi - lo) else f"(v{i} - {lo!r}D) / {width!r}D"
        bucket = "0" if finish else f"least({BUCKETS - 1}, cast(floor({place}) as int))"
        chains.setdefault(i, []).append(f"WHEN v{i} >= {lo!r}D AND v{i} <= {hi!r}D THEN named_struct('interval', {number}, 'bucket', {bucket}, 'value', v{i})")
    cells = slim.select(F.expr("explode(array(" + ", ".join(f"CASE {' '.join(parts)} END" for parts in chains.values()) + "))").alias("c"))
    cells = cells.filter("c is not null").select("c.*")
    keys = ["interval", "value"] if finish else ["interval", "bucket"]
    rows = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(cells["value"]).alias("lo"), F.max(cells["value"]).alias("hi")).collect()
    counted: dict[int, list] = {}
    for row in sorted(rows, key=lambda row: row["lo"]):
        counted.setdefault(row["interval"], []).append(row)
    return counted


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    from sievestone.functions.columns import named

    return {name: values[0] for name, values in quantiles(df, {c: (named(c), [0.5]) for c in columns}).items()}
