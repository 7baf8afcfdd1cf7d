"""Working tables the registered queries share, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SALES_COLUMNS = ["status", "price", "priority", "segment", "balance", "nation"]
SALES_NUMBERS = ["price", "balance", "nation"]
SALES_TEXTS = ["status", "priority", "segment"]


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with its customer: three texts, three numbers, unique row_id."""
    return read(spark, folder, "orders").join(
        read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"))


SALES_SQL = """sales AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority,
         c_mktsegment AS segment, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def messy(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with every kind of disguised missing value, planted by key hash."""
    from sievestone.functions.hashing import draw, draw_below

    spot = lambda name, n: draw_below(draw(name, F.col("c_custkey")), n)
    balance = F.round(F.abs("c_acctbal"), 2)
    cents = F.format_string("%.2f", balance)
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.when(spot("seg", 20) == 0, "?").when(spot("seg", 20) == 1, " N/A ").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(spot("bal", 25) == 0, F.lit(-999.0)).otherwise(balance).alias("balance"),
        F.when(spot("cma", 30) == 0, "-").otherwise(F.replace(cents, F.lit("."), F.lit(","))).alias("comma_price"),
        F.when(spot("txt", 30) == 0, F.lit("")).otherwise(cents).alias("text_price"),
        F.format_string("%05d", (F.col("c_custkey") % 10000).cast("long")).alias("zip"),
        F.when(spot("wrd", 12) == 0, "Unknown / missing").otherwise(F.col("c_mktsegment")).alias("word"),
        F.when(spot("maj", 10) < 6, F.lit(-1.0)).otherwise(balance).alias("mostly_code"),
        F.when(spot("tcd", 15) == 0, "-9").when(spot("tcd", 15) == 1, "-9.0").otherwise(F.col("c_mktsegment")).alias("text_code"),
        (F.col("c_nationkey") % 2 == 0).alias("even"),
        F.col("c_nationkey").alias("nation"),
    )


def _spot(name: str, n: int) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws(':', '{name}', c_custkey)), 1, 8)) AS BIGINT) % {n})"


MESSY_SQL = f"""messy AS (
  SELECT c_custkey AS row_id,
    CASE WHEN {_spot('seg', 20)} = 0 THEN '?' WHEN {_spot('seg', 20)} = 1 THEN ' N/A ' ELSE c_mktsegment END AS segment,
    CASE WHEN {_spot('bal', 25)} = 0 THEN -999.0 ELSE CAST(round(abs(c_acctbal), 2) AS DOUBLE) END AS balance,
    CASE WHEN {_spot('cma', 30)} = 0 THEN '-' ELSE replace(printf('%.2f', round(abs(c_acctbal), 2)), '.', ',') END AS comma_price,
    CASE WHEN {_spot('txt', 30)} = 0 THEN '' ELSE printf('%.2f', round(abs(c_acctbal), 2)) END AS text_price,
    printf('%05d', c_custkey % 10000) AS zip,
    CASE WHEN {_spot('wrd', 12)} = 0 THEN 'Unknown / missing' ELSE c_mktsegment END AS word,
    CASE WHEN {_spot('maj', 10)} < 6 THEN -1.0 ELSE CAST(round(abs(c_acctbal), 2) AS DOUBLE) END AS mostly_code,
    CASE WHEN {_spot('tcd', 15)} = 0 THEN '-9' WHEN {_spot('tcd', 15)} = 1 THEN '-9.0' ELSE c_mktsegment END AS text_code,
    c_nationkey % 2 = 0 AS even, c_nationkey AS nation
  FROM customer)"""
