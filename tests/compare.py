"""Runs registered queries on Spark and their SQL on DuckDB over the same files and compares the values."""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: repr(r))


def compare(spark_df, relation) -> str:
    a_columns, b_columns = sorted(spark_df.columns), sorted(relation.columns)
    if a_columns != b_columns:
        return f"columns differ: {a_columns} / {b_columns}"
    a = as_rows(spark_df.columns, spark_df.collect())
    b = as_rows(relation.columns, relation.fetchall())
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}; only in one: {sorted(set(map(repr, a)) ^ set(map(repr, b)))[:4]}"
    wrong = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ: {wrong[:2]}"
    return f"ok {len(a)} rows" if a else "ok but EMPTY"


def main(names=None, folder="/root/testdata/sf0.01"):
    import duckdb

    import __spark_entry__ as entry_module
    from sievestone.session import build_session

    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name, function in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            frame = function(spark, folder)
            if name in oracles:
                verdict = compare(frame, db.sql(oracles[name]))
            else:
                rows = frame.collect()
                verdict = f"rows only: {len(rows)} {rows[:3] if names else ''}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:900]}"
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
        if not verdict.startswith(("ok", "rows only")):
            bad.append(name)
    print("BAD:", bad)
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("/")]
    folders = [a for a in sys.argv[1:] if a.startswith("/")]
    sys.exit(1 if main(args, *folders) else 0)
