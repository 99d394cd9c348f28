"""Registration of queries, and the test tables under the names of the document library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EPOCH = "2024-01-01"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """document_id, filename, status, text, byte_size, created_at; an hour lies between documents."""
    t = table(spark, d, "documents")
    at = F.lit(EPOCH).cast("timestamp_ntz") + F.make_interval(hours=F.col("doc_id").cast("int"))
    return t.select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.col("lang").alias("status"),
        "text", F.col("n_chars").alias("byte_size"), at.alias("created_at"))


def classifications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").cast("string").alias("code"),
        F.col("toxic").cast("string").alias("label"))


#: The same in SQL.
DOCS = f"docs AS (SELECT doc_id AS document_id, source AS filename, lang AS status, text, n_chars AS byte_size, TIMESTAMP '{EPOCH}' + to_hours(doc_id) AS created_at FROM documents)"
CLASSES = "classes AS (SELECT doc_id AS document_id, quality::varchar AS code, toxic::varchar AS label FROM labels)"


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """Output versions: an order is a run of its customer's document."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"),
        status.alias("status"), F.lit("clean").alias("stage"), F.lit(None).cast("string").alias("error"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS document_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Transcript segments as rows: document_id, seg, text, speaker, start_seconds, duration_seconds."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seg"), "text",
        F.col("role").alias("speaker"), (F.col("turn") * 5.0 + F.col("turn") % 3 * 0.25).alias("start_seconds"),
        F.when(F.col("turn") % 2 == 0, 1.0).otherwise(2.5).alias("duration_seconds"))


SEGMENTS = "segs AS (SELECT conv_id AS document_id, turn AS seg, text, role AS speaker, turn * 5.0::double + turn % 3 * 0.25::double AS start_seconds, CASE WHEN turn % 2 = 0 THEN 1.0::double ELSE 2.5::double END AS duration_seconds FROM conversations)"


def segment_arrays(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("seg", F.struct("text", "start_seconds", "duration_seconds", "speaker").alias("s"))
    return segments(spark, d).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
