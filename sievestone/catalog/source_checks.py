"""Registered queries: readers, writers and nested data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievestone.catalog.register import registry
from sievestone.catalog.tables import read, sales
from sievestone.operators import sampling
from sievestone.plans.audit import audit, repair
from sievestone.session import ensure_checkpoint_dir
from sievestone.sources import readers, writers

QUERIES, SQL, query = registry()


def scratch(spark) -> str:
    """A new folder for files a query writes and reads back, inside the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("load_parquet_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    df, _ = readers.load_table(spark, f"{sf}/orders.parquet")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("pruned_parquet_read", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, sf):
    return readers.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("file_row_ids", "SELECT row_number() OVER () - 1 AS row_id, event_id FROM events")
def _(spark, sf):
    return readers.with_row_id(read(spark, sf, "events")).select("row_id", "event_id")


@query("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, replace(CAST(c_acctbal AS VARCHAR), '.', ',') AS c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    folder = scratch(spark)
    shown = read(spark, sf, "customer").select("c_custkey", "c_name", F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("c_acctbal"), "c_mktsegment")
    shown.write.mode("overwrite").option("header", True).option("sep", ";").csv(f"{folder}/customer.csv")
    return readers.read_csv(spark, f"{folder}/customer.csv")[0]


@query("csv_quoted_breaks", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, text FROM documents")
def _(spark, sf):
    folder = scratch(spark)
    texts = read(spark, sf, "documents").select("doc_id", "source", "text")
    texts.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/documents.csv")
    return readers.read_csv(spark, f"{folder}/documents.csv")[0]


@query("csv_stray_quote", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 50 = 7 THEN p_size || '" ' || p_brand ELSE p_brand END AS shown, p_type FROM part""")
def _(spark, sf):
    folder = scratch(spark)
    shown = F.when(F.col("p_partkey") % 50 == 7, F.concat(F.col("p_size").cast("string"), F.lit('" '), F.col("p_brand"))).otherwise(F.col("p_brand"))
    lines = read(spark, sf, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), shown, "p_type").alias("value"))
    head = spark.range(1).select(F.lit("p_partkey|shown|p_type").alias("value"))
    head.unionByName(lines).coalesce(1).write.text(f"{folder}/part.csv")
    return readers.read_csv(spark, f"{folder}/part.csv")[0]


@query("json_lines_flattened", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", event_type FROM events""")
def _(spark, sf):
    folder = scratch(spark)
    events = read(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"), "event_type")
    events.write.mode("overwrite").json(f"{folder}/events.jsonl")
    return readers.read_json(spark, f"{folder}/events.jsonl", lines=True).select("event_id", F.col("`props.k`"), "event_type")


@query("json_wrapped_records", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(spark, sf):
    wrapped = read(spark, sf, "nation").select("n_nationkey", "n_name").groupBy(F.pmod("n_nationkey", F.lit(4))).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("data")).select("data")
    return readers.records_from_json(wrapped).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("json_column_arrays", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    packed = read(spark, sf, "region").groupBy(F.pmod("r_regionkey", F.lit(2)).alias("g")).agg(F.collect_list("r_regionkey").alias("r_regionkey"), F.collect_list("r_name").alias("r_name")).drop("g")
    return readers.records_from_json(packed).select("r_regionkey", "r_name")


@query("parse_json_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def _(spark, sf):
    return readers.parse_json_column(read(spark, sf, "events").select("event_id", "props"), "props", "k long")


@query("stringify_containers", "SELECT vec_id, len(embedding) AS size, label FROM embeddings")
def _(spark, sf):
    text = readers.stringify_containers(read(spark, sf, "embeddings"))
    return text.select("vec_id", F.size(F.from_json("embedding", "array<float>")).cast("long").alias("size"), "label")


@query("file_fingerprint")
def _(spark, sf):
    return readers.fingerprint(spark, f"{sf}/*.parquet").select("bytes", "sha256")


@query("header_cleanup", "SELECT r_regionkey AS a, r_regionkey + 1 AS \"a.1\", r_name AS \"Unnamed: 2\" FROM region")
def _(spark, sf):
    region = read(spark, sf, "region").select("r_regionkey", (F.col("r_regionkey") + 1).alias("next"), "r_name")
    return region.toDF(*readers.unique_headers(["a", " a ", ""]))


@query("written_outputs")
def _(spark, sf):
    folder = scratch(spark)
    state = audit(sales(spark, sf), "row_id", detectors={"missing_values", "duplicates", "outliers"})
    names = writers.write_outputs(state, repair(state), folder)
    out = None
    for name in names:
        row = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("fit_log_append", "SELECT 'random_forest' AS model, 2::BIGINT AS fits, CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS BIGINT) AS rows")
def _(spark, sf):
    folder = f"{scratch(spark)}/fits"
    for name in ("orders", "customer"):
        writers.append_fit_log(spark, folder, "check", "random_forest", name, read(spark, sf, name).count(), 0.0)
    return spark.read.parquet(folder).groupBy("model").agg(F.count(F.lit(1)).alias("fits"), F.sum("n_rows").alias("rows"))


@query("reproducible_subsample", "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5(concat_ws(':', '6', doc_id))) <= 200")
def _(spark, sf):
    return sampling.sample_rows(read(spark, sf, "documents"), "doc_id", 200, 6).select("doc_id")
