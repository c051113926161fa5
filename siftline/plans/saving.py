"""Queries that save rows in tables of their own and change them there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import dedup
from siftline.plans.registry import CONTENTS_SQL, contents, query
from siftline.sources.buckets import Bucketed
from siftline.sources.shared import own_path
from siftline.sources.tables import table
from siftline.streaming.saves import History


@query(
    f"""WITH {CONTENTS_SQL}, h AS (SELECT *, sha256(content) AS content_hash, id % 3 AS batch_id FROM contents),
      a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY batch_id, pos) = 1)
    SELECT id, content_hash, CAST(batch_id AS BIGINT) AS batch_id FROM a QUALIFY row_number() OVER (PARTITION BY url, platform ORDER BY batch_id, pos) = 1"""
)
def saved_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents saved in three batches, of which the second runs twice."""
    hashed = contents(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256)).select("id", "pos", "content_hash", "url", "platform")
    history = History(own_path(spark, "history"), hashed.schema, 1)
    for batch in (0, 1, 1, 2):
        history.save(hashed.filter(F.col("id") % 3 == batch), batch)
    return history.rows(spark).select("id", "content_hash", "batch_id")


SPENT_SQL = "spent AS (SELECT o_custkey, max(o_orderdate) AS latest, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)"


@query(
    f"""WITH {SPENT_SQL}, b AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, TIMESTAMP '1996-06-01' AS updated_at, CAST(0 AS BIGINT) AS cents FROM customer),
      n AS (SELECT o_custkey AS id, 'name ' || o_custkey AS name, '' AS segment, latest AS updated_at, CAST(cents AS BIGINT) AS cents FROM spent WHERE o_custkey % 50 = 1),
      u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, new DESC) AS k FROM (SELECT *, 0 AS new FROM b UNION ALL SELECT *, 1 AS new FROM n))
    SELECT id, CASE WHEN id % 40 = 3 THEN 'renamed' ELSE name END AS name, segment, updated_at, cents FROM u WHERE k = 1 AND id % 30 <> 7"""
)
def bucket_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table after an upsert, an update and a delete."""
    made = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("1996-06-01").cast("timestamp_ntz").alias("updated_at"), F.lit(0).cast("long").alias("cents")
    )
    kept = Bucketed(own_path(spark, "customers"), ("id",), 32, made.schema)
    kept.create(made)
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 50 = 1")
    spent = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated_at"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    kept.upsert(spent.select(F.col("o_custkey").alias("id"), F.concat(F.lit("name "), "o_custkey").alias("name"), F.lit("").alias("segment"), "updated_at", "cents"), "updated_at")
    kept.update(kept.rows(spark).filter("id % 40 = 3").select("id", F.lit("renamed").alias("name")), ["name"])
    kept.delete(kept.rows(spark).filter("id % 30 = 7").select("id"))
    return kept.rows(spark)


WHOLE_SQL = """WITH RECURSIVE p AS (SELECT doc_id AS pos, substring(text, 1, 3) AS url, source || lang || (n_chars % 9) AS content_hash, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
 r AS (SELECT pos, k, true AS kept, [url] AS urls, [content_hash] AS hashes FROM p WHERE k = 1
   UNION ALL SELECT p.pos, p.k, NOT (list_contains(urls, p.url) OR list_contains(hashes, p.content_hash)),
     CASE WHEN list_contains(urls, p.url) OR list_contains(hashes, p.content_hash) THEN urls ELSE list_append(urls, p.url) END,
     CASE WHEN list_contains(urls, p.url) OR list_contains(hashes, p.content_hash) THEN hashes ELSE list_append(hashes, p.content_hash) END
   FROM r JOIN p ON p.k = r.k + 1)
SELECT pos FROM r WHERE kept"""


@query(WHOLE_SQL)
def greedy_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy over all documents as one batch, by how they begin and by a coarse key."""
    docs = table(spark, sf_dir, "documents")
    key = F.concat("source", "lang", (F.col("n_chars") % 9).cast("string"))
    rows = docs.select(F.lit(0).alias("batch_id"), F.col("doc_id").alias("pos"), F.substring("text", 1, 3).alias("url"), key.alias("content_hash"))
    return dedup.greedy(rows).select("pos")
