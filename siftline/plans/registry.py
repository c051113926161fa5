"""Queries by name, each with the SQL it must agree with, if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLATFORMS = ["weibo", "bilibili", "xiaohongshu", "douyin", "news"]
AS_OF = "2024-02-01 00:00:00"

#: The documents as crawled contents, in DuckDB's SQL; ``contents`` below is the same in Spark.
CONTENTS_SQL = """contents AS (
  SELECT doc_id AS id, doc_id AS pos, substring(text, 1, 60) AS title, text AS content, md5(text) AS url,
    list_extract(['weibo', 'bilibili', 'xiaohongshu', 'douyin', 'news'], CAST(substring(source, 4) AS INTEGER) % 5 + 1) AS platform,
    source AS author,
    CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) END AS published_at
  FROM documents)"""


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contents: title, platform by source, time by id (null for every tenth), url by content."""
    docs = table(spark, sf_dir, "documents")
    platform = F.get(F.array(*map(F.lit, PLATFORMS)), (F.substring("source", 4, 9).try_cast("int") % 5))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("pos"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.md5("text").alias("url"),
        platform.alias("platform"),
        F.col("source").alias("author"),
        F.when(F.col("doc_id") % 10 != 0, at).alias("published_at"),
    )
