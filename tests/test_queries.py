"""A few registered queries against their SQL on the smallest data; the whole list runs with tests/compare.py."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

spec = importlib.util.spec_from_file_location("compare", Path(__file__).with_name("compare.py"))
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in compare.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["prepare_typed_table", "detect_duplicate_rows", "detect_outlier_cells", "inject_feature_corruption", "spelling_rules",
                                  "impute_nearest_rows", "repair_policy", "priority_sensitivity", "spearman_matrix", "stratified_folds", "ecdf"])
def test_query_equals_sql(spark, db, name):
    frame = entry_module.queries()[name](spark, FOLDER)
    verdict = compare.compare(frame, db.sql(entry_module.oracle_sql()[name]))
    assert verdict.startswith("ok"), verdict


def test_entry_and_names(spark):
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200
    assert entry_module.entry(spark).count() == 7
