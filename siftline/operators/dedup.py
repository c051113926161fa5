"""Duplicates: staged, greedy over two keys, against history; unique keys; keep-first windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.classify import basic_quality, relevance
from siftline.functions.text import content_md5, edge_hash, or_empty
from siftline.sources.shared import stored

YEAR = "interval 365 days"


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def relevant(df: DataFrame, query: str, pos: str = "pos", least: int = 3) -> DataFrame:
    """Rows with a score, and of those without one such as are among the first three rows (or at a place of theirs).

    The first three come from a limit, not from a window over all rows, which would be one task.
    """
    scored = df.withColumn("score", relevance(F.col("title"), F.col("content"), query))
    first = scored.select(pos).orderBy(pos).limit(least).distinct().withColumn("__first", F.lit(True))
    return scored.join(F.broadcast(first), pos, "left").filter((F.col("score") > 0) | F.col("__first")).drop("__first")


def staged(posts: DataFrame, query: str, as_of: Column, most: int = 10) -> DataFrame:
    """By URL, then by the hash of the first 200 characters, then by quality and relevance; newest ``most`` rows.

    Columns: pos, url, title, content, published_at and any others.
    """
    by_url = keep_first(posts, ["url"], ["pos"])
    hashed = by_url.withColumn("content_hash", content_md5(F.col("title"), F.col("content"), 200))
    by_hash = keep_first(hashed, ["content_hash"], ["pos"])
    fine = by_hash.filter(basic_quality(F.col("title"), F.col("content")))
    return newest(relevant(fine, query), as_of, most)


def newest(posts: DataFrame, as_of: Column, most: int, pos: str = "pos") -> DataFrame:
    """The newest rows; undated ones count as a year old; ties by position."""
    return posts.orderBy(F.coalesce("published_at", as_of - F.expr(YEAR)).desc(), pos).limit(most)


def greedy(posts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Row by row within a batch, by ``pos``: skip a row whose url or hash is that of a kept row; else keep it.

    Rows that fail the quality test must be filtered before: only kept rows leave their keys. A null is a key like any other;
    of rows at the same place any may be first.

    The order doesn't make it sequential: a row is kept as soon as no undecided row before it shares its url or its
    hash, and then the rows that share one with it go. Rounds of this give the same rows as the loop. A key's rows are summed
    up before they are shuffled, so neither a batch nor a key is one task's. There are as many rounds as the longest
    chain of rows each of which waits for the one before, few where keys don't follow the order.
    """
    schema = posts.schema
    keys = {k: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in (batch, "url", "content_hash")}
    numbered = posts.withColumn("__id", F.monotonically_increasing_id())
    rows = stored(numbered.select("*", *(v.alias(f"__{k}") for k, v in keys.items())), "posts")
    sides = [[f"__{batch}", f"__{k}"] for k in ("url", "content_hash")]
    order = F.struct("pos", "__id")
    undecided = rows.select("__id", "pos", *(f"__{k}" for k in keys))
    kept = undecided.select("__id").limit(0)
    while not undecided.isEmpty():
        first = undecided
        for k, side in enumerate(sides):
            first = first.join(undecided.groupBy(*side).agg(F.min(order).alias(f"__first{k}")), side)
        last = [F.col("__first0.__id") == F.col("__id"), F.col("__first1.__id") == F.col("__id")]
        fresh = stored(first.filter(last[0] & last[1]).select(undecided.columns), "kept")
        kept = kept.union(fresh.select("__id"))
        for side in sides:
            undecided = undecided.join(fresh.select(*side), side, "left_anti")
        undecided = stored(undecided.select("__id", "pos", *(f"__{k}" for k in keys)), "undecided")
    return rows.join(kept, "__id", "left_semi").select(schema.names)


def new_contents(batch: DataFrame, history: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Rows of a batch whose hash history doesn't have, nor, if they have a url, their (url, platform); each hash once.

    A row without a hash is like no other by it. ``addresses`` has history's (url, platform), where they are kept apart.
    """
    by_hash = batch.join(history.select("content_hash").distinct(), "content_hash", "left_anti")
    known = (history if addresses is None else addresses).filter("url <> ''").select("url", "platform").distinct()
    by_url = by_hash.join(known, ["url", "platform"], "left_anti").withColumn("__alone", F.monotonically_increasing_id())
    # a row that is like no other is a group of its own, so that no branch of the plan makes the rows again
    hash_key = F.when(F.col("content_hash").isNull(), F.col("__alone"))
    once = keep_first(by_url.withColumn("__key", hash_key), ["content_hash", "__key"], ["pos"])
    url_key = F.when(F.coalesce("url", F.lit("")) == "", F.col("__alone"))
    return keep_first(once.withColumn("__key", url_key), ["url", "platform", "__key"], ["pos"]).drop("__key", "__alone")


def saved(batch: DataFrame, history: DataFrame, as_of: int) -> DataFrame:
    """What a batch adds to history, once each; without an id of its own a row is named by its hash and the time."""
    fresh = new_contents(batch, history)
    made = F.concat(F.substring("content_hash", 1, 8), F.lit(f"_{as_of}"))
    return fresh.withColumn("origin_id", F.coalesce(F.nullif("origin_id", F.lit("")), made))


def save_counts(batch: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: rows of a batch, those saved, and those left out."""
    rows = batch.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    kept = fresh.agg(F.count("*").alias("saved")).withColumn("one", F.lit(1))
    return rows.join(kept, "one").select("total", "saved", (F.col("total") - F.col("saved")).alias("skipped"))


def incremental(posts: DataFrame, history: DataFrame) -> DataFrame:
    """Posts of creators that history has neither by the hash of title and content nor by creator and a post id of its own; once each.

    Columns of posts: pos, creator_id, post_id, title, content; of history: creator_id, post_id, content_hash.
    """
    hashed = posts.withColumn("content_hash", edge_hash(F.concat(or_empty(F.col("title")), F.lit("|"), or_empty(F.col("content")))))
    by_hash = hashed.join(history.select("content_hash"), "content_hash", "left_anti")
    known = history.filter("post_id <> ''").select("creator_id", "post_id")
    fresh = keep_first(by_hash.join(known, ["creator_id", "post_id"], "left_anti"), ["content_hash"], ["pos"])
    named = fresh.filter("post_id <> ''")
    return keep_first(named, ["creator_id", "post_id"], ["pos"]).unionByName(fresh.filter("coalesce(post_id, '') = ''"))


def violations(df: DataFrame, keys: list[str], sparse: bool = False) -> DataFrame:
    """Keys that more than one row has; sparse keys pass rows without any of them."""
    if sparse:
        df = df.filter(F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
