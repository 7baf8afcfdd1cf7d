"""The corpus pipeline: toxic texts, near duplicates and benchmark leaks are dropped, what is left is encoded and decoded again.

Every stage takes (spark, docs, sf_dir) and returns a table; `run` writes each stage as Parquet and reads it as the next one's input.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm import bpe, decontaminate, minhash, toxicity
from sievestone.llm.shared import read, scratch
from sievestone.session import cut_lineage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the learned lexicon does not call toxic. A row is judged by its own text: null and empty texts get the score of a text
    without hits, rows with a null or repeated doc_id are judged alike, and an empty table stays empty."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the smallest doc_id, null last. Rows are numbered, so null and repeated ids make no
    difference; of rows without words only those repeated in full are one group."""
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shingle=5).select(F.col("doc_id").alias("_row"), "component_id")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    own = rows.select("_row", "doc_id", F.xxhash64("text").alias("hash"), F.when(wordless, F.to_json(F.struct(*docs.columns))).alias("whole"))
    groups = own.join(found, "_row").groupBy(F.coalesce("whole", F.col("component_id").cast("string")).alias("group"))
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "_row")).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item. A row is judged by its own text, whatever its doc_id; null and empty texts hold none, and an
    empty table stays empty."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for every row: null and empty texts have no ids, repeated rows come back as often, an empty table gives no rows."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", without_toxic), ("minhash_near_duplicates", without_near_duplicates), ("benchmark_decontamination", without_benchmark), ("byte_level_bpe", tokens)]
#: Learned scores and merges can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; a stage that keeps no row leaves an empty table to the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
