"""Queries over rules: validity, relatedness, projections, validators, cards, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import classify, text, urls
from siftline.functions import vocabulary as V
from siftline.operators import records, store
from siftline.plans.content import BASIC_SQL, CLEAN_SQL, GENERAL_TAGS_SQL, TAGS_SQL, TEXT_TITLE, WORTH_SQL, any_sql, author_sql, count_sql, distinct_sql, trimmed
from siftline.plans.registry import CONTENTS_SQL, as_of, contents, query
from siftline.plans.tables import TASKS_SQL, tasks
from siftline.sources.tables import by_id, table, with_creator_defaults

HOST_SQL = " ".join(f"WHEN contains(url, '{h}') THEN {any_sql(w, TEXT_TITLE[1])}" for h, w in V.HOST_DYNAMIC.items())


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, NOT {any_sql(V.CRITICAL_WORDS, *TEXT_TITLE)} AND length({trimmed("content")}) >= 30
      AND CASE {HOST_SQL} ELSE NOT ({any_sql(V.SOFT_STATIC, TEXT_TITLE[0])} AND length(content) < 200) AND {any_sql(V.GENERIC_DYNAMIC, TEXT_TITLE[1])} END AS valid
    FROM contents"""
)
def valid_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = classify.valid_dynamic(F.col("title"), F.col("content"), F.col("url"))
    return contents(spark, sf_dir).select("id", valid.alias("valid"))


@query(f"WITH {CONTENTS_SQL} SELECT id, {WORTH_SQL} AS worth FROM contents")
def worth_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("id", classify.worth_processing(F.col("title"), F.col("content")).alias("worth"))


BOTH = "lower(title || ' ' || substring(content, 1, 200))"


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, NOT {any_sql(V.NEWS_EXCLUDED, BOTH)} AND strlen(title) > 10 AND strlen(title) < 200 AND contains({BOTH}, 'the') AS news,
      {any_sql(["that", "weibo", "热搜"], BOTH)} AS related, {count_sql(V.RESULT_DYNAMIC, BOTH)} >= 1 AND NOT {any_sql(V.RESULT_STATIC, BOTH)} AS dynamic
    FROM contents"""
)
def result_relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, snippet = F.col("title"), F.substring("content", 1, 200)
    return contents(spark, sf_dir).select(
        "id",
        classify.news_related(title, snippet, "the").alias("news"),
        classify.related(title, snippet, "that", ["weibo", "热搜"]).alias("related"),
        classify.dynamic_result(title, snippet, F.col("url")).alias("dynamic"),
    )


def _platform_quality_sql() -> str:
    parts = []
    for name, (least_title, least_content, in_url, in_content) in classify.PLATFORM_QUALITY.items():
        also = f" AND ({any_sql(in_url, 'url')} OR contains(lower(content), '{in_content}'))" if in_url else ""
        blank = f"{trimmed('title')} <> '' AND {trimmed('content')} <> ''"
        parts.append(f"WHEN platform = '{name}' THEN length(title) >= {least_title} AND length(content) >= {least_content} AND {blank}{also}")
    return f"CASE {' '.join(parts)} ELSE {BASIC_SQL} END"


@query(f"WITH {CONTENTS_SQL} SELECT id, platform, {_platform_quality_sql()} AS fine FROM contents")
def platform_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = classify.platform_quality(F.col("title"), F.col("content"), F.col("url"), F.col("platform"))
    return contents(spark, sf_dir).select("id", "platform", fine.alias("fine"))


def _parse_sql() -> str:
    fits = " ".join(
        f"WHEN '{p}' THEN {count_sql(V.FEATURES[p][0], *TEXT_TITLE)} >= {V.FEATURES[p][1]} AND length(clean) >= {least}" for p, least in records.LEAST_CONTENT.items()
    )
    author = " ".join(f"WHEN '{p}' THEN {author_sql(p)}" for p in records.LEAST_CONTENT)
    tags = " ".join(f"WHEN '{p}' THEN {TAGS_SQL[p]}" for p in records.LEAST_CONTENT)
    videos = ", ".join(
        f"nullif(CASE WHEN starts_with(regexp_extract(content, '{p}'), 'http') OR regexp_extract(content, '{p}') = '' THEN '' ELSE 'https://www.bilibili.com/video/' END || regexp_extract(content, '{p}'), '')"
        for p in V.BILIBILI_VIDEOS
    )
    images = f"regexp_extract_all(content, '(?i){V.IMAGE_URL}')"
    title = trimmed(f"regexp_replace(regexp_replace(substring(title, 1, {records.MOST_TITLE}), '{V.TITLE_SUFFIX}', '', 'g'), '\\s+', ' ', 'g')")
    return f"""WITH {CONTENTS_SQL}, k AS ({CLEAN_SQL}), j AS (SELECT contents.*, clean FROM contents JOIN k ON k.id = contents.id WHERE {WORTH_SQL}),
      s AS (SELECT *, coalesce(CASE platform {fits} ELSE false END, false) AS specific FROM j),
      t AS (SELECT *, CASE WHEN specific THEN CASE platform {tags} END ELSE {GENERAL_TAGS_SQL} END AS found FROM s WHERE specific OR length(clean) >= 30)
    SELECT id, platform, specific, {title} AS title, substring(clean, 1, {records.MOST_CONTENT}) AS content,
      CASE WHEN specific THEN CASE platform {author} END ELSE '未知作者' END AS author, {distinct_sql("found")} AS tags, {distinct_sql(images, 5)} AS images,
      CASE WHEN specific AND platform = 'bilibili' THEN coalesce({videos}, CASE WHEN contains(url, '/video/') THEN url END) END AS video_url FROM t"""


@query(_parse_sql())
def platform_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.parsed(contents(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, "|") for c in ("tags", "images")})


@query()
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.crawled(table(spark, sf_dir, "pages"))


@query(
    """SELECT page_id, length(html) >= 100 AND regexp_matches(html, '(?i)<html') AND regexp_matches(html, '(?i)<body') AS valid,
      CASE WHEN contains(lower(url), 'search') OR contains(lower(url), 'topic') OR contains(lower(url), 'hashtag') THEN 20 ELSE 10 END AS rounds FROM pages"""
)
def html_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", classify.valid_html(F.col("html")).alias("valid"), urls.scroll_rounds(F.col("url")).alias("rounds")
    )


CREATOR_PAGES_SQL = """WITH c AS (SELECT c_custkey, list_extract(['weibo', 'bilibili', 'xiaohongshu', 'douyin', 'news'], CAST(c_custkey % 5 AS INTEGER) + 1) AS platform,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE replace(c_name, '#', '_') END AS creator, c_custkey % 2 = 0 AS number FROM customer)
SELECT c_custkey, platform, creator, CASE
  WHEN platform = 'weibo' AND number THEN 'https://weibo.com/u/' || creator || '/home|https://weibo.com/u/' || creator || '?tabtype=feed|https://weibo.com/' || creator || '?is_all=1'
  WHEN platform = 'weibo' THEN 'https://weibo.com/' || creator || '?tabtype=feed|https://weibo.com/u/' || creator || '?tabtype=feed|https://weibo.com/' || creator || '?is_all=1'
  WHEN platform = 'bilibili' AND number THEN 'https://space.bilibili.com/' || creator || '/dynamic|https://space.bilibili.com/' || creator || '/video|https://space.bilibili.com/' || creator
  WHEN platform = 'bilibili' THEN 'https://www.bilibili.com/v/popular/all|https://t.bilibili.com|https://www.bilibili.com/v/popular/weekly'
  WHEN platform = 'xiaohongshu' THEN 'https://www.xiaohongshu.com/explore|https://www.xiaohongshu.com/explore/homefeed.json|https://www.xiaohongshu.com/user/profile/' || creator
  WHEN platform = 'douyin' THEN 'https://www.douyin.com/recommend|https://www.douyin.com/hot|https://www.douyin.com/search/' || creator
  ELSE 'https://www.zhihu.com/hot|https://www.bilibili.com/v/popular/all' END AS pages FROM c"""


@query(CREATOR_PAGES_SQL)
def creator_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    creator = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.replace("c_name", F.lit("#"), F.lit("_")))
    platform = F.get(F.array(*map(F.lit, ["weibo", "bilibili", "xiaohongshu", "douyin", "news"])), (F.col("c_custkey") % 5).cast("int"))
    found = table(spark, sf_dir, "customer").select("c_custkey", platform.alias("platform"), creator.alias("creator"))
    return found.withColumn("pages", F.array_join(urls.platform_pages(F.col("creator"), F.col("platform")), "|"))


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, content AS body, CASE WHEN id % 2 = 0 THEN url || '.jpg' END AS image_url,
      CAST((CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_media FROM contents"""
)
def post_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.array().cast("array<string>")
    given = contents(spark, sf_dir).select(
        "*",
        F.lit("t").alias("task_id"),
        F.lit("o").alias("origin_id"),
        F.when(F.col("id") % 2 == 0, F.array(F.concat("url", F.lit(".jpg")))).otherwise(nothing).alias("images"),
        F.when(F.col("id") % 3 == 0, F.concat("url", F.lit(".mp4"))).otherwise("").alias("video_url"),
        F.col("published_at").alias("created_at"),
    )
    posts = store.as_posts(given)
    return posts.select("id", F.col("content").alias("body"), "image_url", F.size("media_urls").cast("long").alias("n_media"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_id(table(spark, sf_dir, "orders"), "o_orderkey", 77).select("o_orderkey", "o_totalprice")


@query(
    f"WITH {TASKS_SQL} SELECT count(*) AS \"all\", count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,"
    " count(*) FILTER (status = 'completed') AS completed FROM tasks"
)
def status_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.status_cards(tasks(spark, sf_dir), "status", ["pending", "running", "completed"])


@query(
    """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
      round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS success_rate, round(avg(value), 4) AS mean_duration,
      CAST(sum(event_id % 3) AS BIGINT) AS posts, round(sum(event_id % 3) / sum(value), 4) AS posts_per_second FROM events"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration"), (F.col("event_id") % 3).alias("posts")
    )
    return records.batch_summary(results)


@query(
    f"""WITH {CONTENTS_SQL}, a AS (SELECT id, pos, 0 AS source_rank FROM contents WHERE platform = 'weibo' ORDER BY pos LIMIT 30),
      b AS (SELECT id, pos, 1 AS source_rank FROM contents WHERE platform = 'douyin' ORDER BY pos LIMIT 30)
    SELECT id, source_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY source_rank, pos LIMIT 45"""
)
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents(spark, sf_dir).select("id", "pos", "platform")
    sources = [store.equal_where_given(found, platform=p) for p in ("weibo", "douyin")]
    return records.first_of_sources(sources, 45, prefix=30).select("id", "source_rank")


@query(
    """WITH w AS (SELECT o_custkey AS request, o_orderkey FROM orders), k AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 2)
    SELECT request, bool_and(l_orderkey IS NOT NULL) AS complete FROM w LEFT JOIN k ON l_orderkey = o_orderkey GROUP BY 1"""
)
def all_posts_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("post_id"))
    known = table(spark, sf_dir, "lineitem").filter("l_quantity > 2").select(F.col("l_orderkey").alias("post_id"))
    return records.all_pairs_there(asked, known, "request", "post_id")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 60 ELSE c_custkey % 4 * 15 END AS crawl_interval,
      TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(CASE WHEN c_custkey % 4 = 0 THEN 60 ELSE c_custkey % 4 * 15 END AS INTEGER)) AS next_crawl_at FROM customer"""
)
def creator_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("username"), F.lit("").alias("display_name"), (F.col("c_custkey") % 4 * 15).alias("crawl_interval")
    )
    return with_creator_defaults(given, as_of()).select("c_custkey", F.col("crawl_interval").cast("long").alias("crawl_interval"), "next_crawl_at")


@query(
    """SELECT event_id, CASE WHEN n >= 1000000 THEN ((n + 50000) // 100000 // 10) || '.' || ((n + 50000) // 100000 % 10) || 'M'
      WHEN n >= 1000 THEN ((n + 50) // 100 // 10) || '.' || ((n + 50) // 100 % 10) || 'K' ELSE CAST(n AS VARCHAR) END AS shown,
      CASE WHEN event_id % 500 = 0 THEN '未知' ELSE CAST(event_id % 500 // 60 AS VARCHAR) || ':' || lpad(CAST(event_id % 500 % 60 AS VARCHAR), 2, '0') END AS duration,
      CASE WHEN value >= 5 THEN 'high' WHEN value >= 3 THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT *, event_id * event_id AS n FROM events)"""
)
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.compact_number(n).alias("shown"),
        text.minutes_seconds(F.col("event_id") % 500).alias("duration"),
        text.engagement_bucket(F.col("value")).alias("bucket"),
    )
