"""Records made of pages and contents: the platform parse, search records, source unions, cards of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import classify, text, urls
from siftline.functions.html import page_extract

# The least length of a cleaned content on each platform, and the most that is kept of one.
LEAST_CONTENT = {"weibo": 20, "bilibili": 30, "xiaohongshu": 20, "douyin": 20}
MOST_CONTENT, MOST_TITLE = 2000, 200
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/gif", "image/webp", "image/bmp", "image/svg+xml"]
VIDEO_TYPES = ["video/mp4", "video/avi", "video/mov", "video/wmv", "video/flv", "video/webm", "video/mkv", "video/quicktime"]


def parsed(contents: DataFrame) -> DataFrame:
    """Contents worth it as records: cleaned, with author, tags and video by their platform.

    Contents that lack their platform's features, or are too short once cleaned, fall through to the
    general record. Columns: id, url, title, content, platform.
    """
    title, content, url, platform = (F.col(c) for c in ("title", "content", "url", "platform"))
    worth = contents.filter(classify.worth_processing(title, content))
    # a generated column is worked out once; a plain one would be again in every filter that is pushed down, and for every word that is sought
    low = worth.select("*", F.inline(F.array(F.struct(F.lower(title).alias("__title"), F.lower(content).alias("__content")))))
    featured = fits = F.lit(False)
    author = tags = F.lit(None)
    for p, least in LEAST_CONTENT.items():
        here = platform == p
        featured = F.when(here, classify.has_features_in(F.col("__title"), F.col("__content"), p)).otherwise(featured)
        fits = F.when(here, F.char_length("clean") >= least).otherwise(fits)
        author = F.when(here, text.author(content, url, p)).otherwise(author)
        tags = F.when(here, text.platform_tags(content, p)).otherwise(tags)
    once = F.struct(text.clean_content(content, platform).alias("clean"), F.coalesce(featured, F.lit(False)).alias("featured"))
    found = low.select("*", F.inline(F.array(once))).withColumn("specific", F.coalesce(F.col("featured") & fits, F.lit(False)))
    general = F.char_length("clean") >= 30
    video = F.when(F.col("specific") & (platform == "bilibili"), text.bilibili_video(content, url))
    return found.filter(F.col("specific") | general).select(
        "id",
        "platform",
        "specific",
        text.clean_title(F.substring(title, 1, MOST_TITLE)).alias("title"),
        F.substring("clean", 1, MOST_CONTENT).alias("content"),
        F.when(F.col("specific"), author).otherwise(F.lit("未知作者")).alias("author"),
        F.when(F.col("specific"), tags).otherwise(text.hashtags(content)).alias("tags"),
        text.image_urls(content).alias("images"),
        video.alias("video_url"),
    )


def crawled(pages: DataFrame, threshold: int = 10, most_links: int = 50) -> DataFrame:
    """Pages as crawl records: the content, or all text that is left of the page where the content has under ``threshold`` words."""
    words = F.size(F.filter(F.split("content", text.WHITE), lambda x: x != ""))
    content = F.when(words < threshold, F.col("text")).otherwise(F.col("content"))
    return page_extract(pages, pruned=True).select(
        "page_id",
        "url",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("未知标题")).alias("title"),
        content.alias("content"),
        F.slice("links", 1, most_links).alias("links"),
        F.slice("images", 1, 5).alias("images"),
        urls.platform_of(F.col("url")).alias("platform"),
        (content != "").alias("success"),
    )


def first_of_sources(sources: list[DataFrame], limit: int, prefix: int | None = None, order: str = "pos") -> DataFrame:
    """Rows of ordered sources until there are enough. prefix: take so many of each source first."""
    ranked = [
        (s.orderBy(order).limit(prefix) if prefix is not None else s).withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, ranked).orderBy("source_rank", order).limit(limit)


def is_image(mime: Column) -> Column:
    return F.coalesce(mime.isin(IMAGE_TYPES), F.lit(False))


def is_video(mime: Column) -> Column:
    return F.coalesce(mime.isin(VIDEO_TYPES), F.lit(False))


def is_video_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-zA-Z0-9\-_]{6,}$"), F.lit(False))


def status_cards(df: DataFrame, status: str, names: list[str]) -> DataFrame:
    """One row: all rows, and those of each status."""
    return df.agg(F.count("*").alias("all"), *(F.count_if(F.col(status) == n).alias(n) for n in names))


def batch_summary(results: DataFrame) -> DataFrame:
    """Crawls in all, successes, failures, the success rate and times. Columns: success, duration, posts."""
    good = F.count_if(F.col("success"))
    return results.agg(
        F.count("*").alias("total"),
        good.alias("succeeded"),
        (F.count("*") - good).alias("failed"),
        F.round(good / F.count("*"), 6).alias("success_rate"),
        F.round(F.avg("duration"), 4).alias("mean_duration"),
        F.sum("posts").alias("posts"),
        F.round(F.sum("posts") / F.nullif(F.sum("duration"), F.lit(0.0)), 4).alias("posts_per_second"),
    )


def all_there(requests: DataFrame, known: DataFrame, key: str, ids: str, known_id: str) -> DataFrame:
    """For each request whether every id of its array is known; one without ids isn't complete."""
    return all_pairs_there(requests.select(key, F.explode_outer(ids).alias(known_id)), known, key, known_id)


def all_pairs_there(wanted: DataFrame, known: DataFrame, key: str, known_id: str) -> DataFrame:
    """The same of requests that come as one row an id; no request is gathered in one row."""
    hit = known.select(known_id).distinct().withColumn("__hit", F.lit(True))
    return wanted.join(hit, known_id, "left").groupBy(key).agg(F.bool_and(F.coalesce("__hit", F.lit(False))).alias("complete"))
