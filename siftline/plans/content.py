"""Queries over contents and pages: cleaning, extraction, classification, duplicates, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import classify, html, text, urls
from siftline.functions import vocabulary as V
from siftline.operators import dedup
from siftline.plans.registry import AS_OF, CONTENTS_SQL, as_of, contents, query
from siftline.sources.tables import table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TEXT_TITLE = "lower(title)", "lower(content)"


def trimmed(x: str) -> str:
    return TRIM.format(x)


def any_sql(words: list[str], *columns: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words for c in columns) + ")"


def count_sql(words: list[str], *columns: str) -> str:
    return "(" + " + ".join(f"CAST({any_sql([w], *columns)} AS BIGINT)" for w in words) + ")"


RELEVANCE_SQL = """(CASE WHEN contains(lower(title), 'the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(content), 'the') THEN 2 ELSE 0 END)"""
BASIC_SQL = f"length(title) >= 3 AND length(content) >= 10 AND {trimmed('title')} <> '' AND {trimmed('content')} <> ''"
STAGED_SQL = f"""WITH {CONTENTS_SQL},
 w1 AS (SELECT * FROM contents QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1),
 h AS (SELECT *, md5(lower({trimmed("substring(title || content, 1, 200)")})) AS content_hash FROM w1),
 w2 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY pos) = 1),
 fine AS (SELECT *, CAST({RELEVANCE_SQL} AS BIGINT) AS score, row_number() OVER (ORDER BY pos) AS rn FROM w2 WHERE {BASIC_SQL})"""


@query(
    f"{STAGED_SQL} SELECT pos, title, platform, content_hash, score FROM fine WHERE score > 0 OR rn <= 3"
    f" ORDER BY coalesce(published_at, TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) DESC, pos LIMIT 10"
)
def dedup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.staged(contents(spark, sf_dir), "the", as_of())
    return found.select("pos", "title", "platform", "content_hash", "score")


ONE_LINE_SQL = trimmed("replace(title || '|' || content, chr(10), ' ')")


@query(f"WITH {CONTENTS_SQL} SELECT id, sha256(replace({ONE_LINE_SQL}, chr(13), '')) AS content_hash FROM contents")
def content_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("id", text.content_sha256(F.col("title"), F.col("content")).alias("content_hash"))


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, md5(lower({trimmed("substring(title || content, 1, 200)")})) AS md5_200,
    md5(lower({trimmed("title || content")})) AS md5_all FROM contents"""
)
def content_hash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = F.col("title"), F.col("content")
    return contents(spark, sf_dir).select(
        "id", text.content_md5(title, content, 200).alias("md5_200"), text.content_md5(title, content).alias("md5_all")
    )


@query(
    """SELECT doc_id, CASE WHEN strlen(text) < 10 THEN text
    ELSE concat_ws('_', CAST(strlen(text) AS VARCHAR), substring(text, 1, 5), right(text, 5)) END AS edge FROM documents"""
)
def edge_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.edge_hash(F.col("text")).alias("edge"))


STRIP_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {STRIP_SQL} AS body FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query(
    r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages"
)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query(
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*href="([^"]+)"', 1) AS hrefs FROM pages)
    SELECT page_id, CAST(len(hrefs) AS BIGINT) AS n_links, CAST(len(list_distinct(hrefs)) AS BIGINT) AS n_distinct FROM l"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('(?i)<a[^>]*href="([^"]+)"'), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", hrefs.alias("hrefs"))
    return found.select(
        "page_id", F.size("hrefs").cast("long").alias("n_links"), F.size(F.array_distinct("hrefs")).cast("long").alias("n_distinct")
    )


@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_extract(table(spark, sf_dir, "pages"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_ws(F.col("text")).alias("clean"))


def noise_sql(c: str, patterns: list[str], by: str = " ") -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '(?i){p}', '{by}', 'g')"
    return c


CLEAN_SQL = (
    f"WITH {CONTENTS_SQL}, g AS (SELECT id, platform, "
    + noise_sql(STRIP_SQL.replace("html", "content"), V.NOISE)
    + " AS c FROM contents), p AS (SELECT id, CASE platform "
    + " ".join(f"WHEN '{k}' THEN {noise_sql('c', v)}" for k, v in V.PLATFORM_NOISE.items())
    + " ELSE c END AS c FROM g), t AS (SELECT id, "
    + trimmed(r"regexp_replace(c, '\s+', ' ', 'g')")
    + " AS c FROM p) SELECT id, CASE WHEN length(c) < 10 THEN '' ELSE c END AS clean FROM t"
)


@query(CLEAN_SQL)
def clean_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("id", text.clean_content(F.col("content"), F.col("platform")).alias("clean"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '#([^#\s]+)#?', 1)) AS BIGINT) AS n_hashtags,
    CAST(len(regexp_extract_all(text, '@([^\s@]+)', 1)) AS BIGINT) AS n_mentions FROM documents"""
)
def hashtags_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit(r"#([^#\s]+)#?"), F.lit(1))).cast("long").alias("n_hashtags"),
        F.size(F.regexp_extract_all("text", F.lit(r"@([^\s@]+)"), F.lit(1))).cast("long").alias("n_mentions"),
    )


def distinct_sql(items: str, most: int = 10) -> str:
    return f"array_to_string(list_slice(list_filter({items}, lambda x, i: list_position({items}, x) = i), 1, {most}), '|')"


TOPICS_SQL = f"list_filter(list_transform(regexp_extract_all(content, '#([^#]+)#', 1), lambda x: {trimmed('x')}), lambda x: x <> '')"
MENTIONS_SQL = "list_transform(regexp_extract_all(content, '@{}', 1), lambda x: '@' || x)"
XHS_SQL = "list_filter([" + ", ".join(f"'{w}'" for w in V.XHS_TAG_WORDS) + "], lambda x: contains(content, x))"
TAGS_SQL = {
    "xiaohongshu": f"list_concat({TOPICS_SQL}, {XHS_SQL})",
    "bilibili": "list_concat([" + ", ".join(f"'{w}'" for w in V.BILIBILI_TAGS)
    + "], regexp_extract_all(content, '#([^#\\s]+)#?', 1), regexp_extract_all(content, '(游戏|科技|生活|娱乐|音乐|舞蹈|动画|番剧|电影|电视剧)', 1), regexp_extract_all(content, '(UP主|直播|投稿|原创|转载)', 1))",
    "weibo": f"list_concat({TOPICS_SQL}, {MENTIONS_SQL.format(chr(40) + '[^' + chr(92) + 's]+)')})",
}
TAGS_SQL["douyin"] = TAGS_SQL["weibo"]
GENERAL_TAGS_SQL = r"list_concat(regexp_extract_all(content, '#([^#\s]+)#?', 1), " + MENTIONS_SQL.format(r"([^\s@]+)") + ")"


@query(
    f"WITH {CONTENTS_SQL}, t AS (SELECT id, platform, CASE platform "
    + " ".join(f"WHEN '{p}' THEN {x}" for p, x in TAGS_SQL.items())
    + f" ELSE {GENERAL_TAGS_SQL} END AS tags FROM contents) SELECT id, platform, {distinct_sql('tags')} AS tags FROM t"
)
def content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    by_platform = F.when(F.lit(False), F.array().cast("array<string>"))
    for p in ("weibo", "bilibili", "xiaohongshu", "douyin"):
        by_platform = by_platform.when(F.col("platform") == p, text.platform_tags(c, p))
    return contents(spark, sf_dir).select("id", "platform", by_platform.otherwise(text.hashtags(c)).alias("tags")).withColumn("tags", F.array_join("tags", "|"))


def author_sql(platform: str) -> str:
    patterns, in_url, before, default = V.AUTHORS[platform]
    found = [f"nullif(regexp_extract(content, '{p}', 1), '')" for p in patterns]
    if in_url:
        found.append(f"'{before}' || nullif(regexp_extract(url, '{in_url}', 1), '')")
    return f"coalesce({', '.join(found)}, '{default}')"


@query(f"WITH {CONTENTS_SQL} SELECT id, platform, CASE platform " + " ".join(f"WHEN '{p}' THEN {author_sql(p)}" for p in V.AUTHORS) + " ELSE author END AS author FROM contents")
def content_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.lit(False), F.lit(""))
    for p in V.AUTHORS:
        found = found.when(F.col("platform") == p, text.author(F.col("content"), F.col("url"), p))
    return contents(spark, sf_dir).select("id", "platform", found.otherwise(F.col("author")).alias("author"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(url, "^([A-Za-z]+)://", 1).alias("scheme"), urls.url_host(url).alias("host"), urls.url_path(url).alias("path")
    )


@query(
    r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
      lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
    SELECT page_id, regexp_matches(url, '^https?://') AND contains(host, '.') AND NOT (contains(host, 'weibo.com') AND
      (path IN ('', '/') OR regexp_matches(path, '^(/hot/search|/hot/|/search|/login|/register|/home|/index|/about|/help)'))) AS valid,
      NOT regexp_matches(url, '(?i)/(index|home|main)\b|/about\b|/contact\b|/help\b|/terms\b|/privacy\b|/login\b|/register\b|/static/|/assets/|\.(css|js|png|jpg|jpeg|gif|ico)$') AS dynamic FROM p"""
)
def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.is_valid_url(url).alias("valid"), urls.is_dynamic_url(url).alias("dynamic"))


@query(
    """SELECT page_id, CASE WHEN contains(lower(url), 'weibo.com') THEN 'weibo'
      WHEN contains(lower(url), 'bilibili.com') OR contains(lower(url), 'b23.tv') THEN 'bilibili'
      WHEN contains(lower(url), 'xiaohongshu.com') OR contains(lower(url), 'xhs.cn') THEN 'xiaohongshu'
      WHEN contains(lower(url), 'douyin.com') OR contains(lower(url), 'tiktok.com') THEN 'douyin' ELSE 'news' END AS platform FROM pages"""
)
def detect_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.platform_of(F.col("url")).alias("platform"))


@query(
    f"SELECT page_id, {any_sql(V.IMAGE_PARTS, 'lower(url)')} OR regexp_matches(lower(url), '{V.IMAGE_PATH}') AS is_image FROM pages"
)
def is_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.is_image_url(F.col("url")).alias("is_image"))


@query(
    f"WITH {CONTENTS_SQL} SELECT id, "
    + ", ".join(f"{count_sql(w, *TEXT_TITLE)} AS {p}_score" for p, (w, _) in V.FEATURES.items())
    + " FROM contents"
)
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = F.col("title"), F.col("content")
    return contents(spark, sf_dir).select("id", *(classify.feature_score(title, content, p).alias(f"{p}_score") for p in V.FEATURES))


@query(
    f"""WITH {CONTENTS_SQL}, s AS (SELECT id, {count_sql(V.STATIC_TYPE, *TEXT_TITLE)} AS s, {count_sql(V.DYNAMIC_TYPE, *TEXT_TITLE)} AS d,
      {count_sql(V.WEIBO_TYPE, *TEXT_TITLE)} AS w FROM contents)
    SELECT id, CASE WHEN s > d THEN '静态页面 (静态特征:' || s || ', 动态特征:' || d || ')'
      WHEN d > 0 OR w > 0 THEN '动态内容 (动态特征:' || d || ', 微博特征:' || w || ')'
      ELSE '未知内容类型 (静态特征:' || s || ', 动态特征:' || d || ')' END AS content_type FROM s"""
)
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("id", classify.content_type(F.col("title"), F.col("content")).alias("content_type"))


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, CASE
      WHEN {any_sql(V.MISSING_USER, *TEXT_TITLE)} THEN CASE WHEN platform = 'weibo' THEN '微博用户不存在' ELSE '用户不存在' END
      WHEN {any_sql(V.ACCESS_ERROR, *TEXT_TITLE)} THEN '页面访问错误' WHEN {any_sql(V.HTTP_ERROR, *TEXT_TITLE)} THEN 'HTTP错误'
      WHEN {any_sql(V.LOGIN_ERROR, TEXT_TITLE[0])} THEN '需要登录' WHEN length({trimmed("content")}) < 50 THEN '内容过短' END AS kind FROM contents"""
)
def page_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.page_error(F.col("title"), F.col("content"), F.col("platform"))
    return contents(spark, sf_dir).select("id", found["kind"].alias("kind"))


@query(
    f"WITH {CONTENTS_SQL} SELECT id, CASE "
    + " ".join(f"WHEN {any_sql(words, TEXT_TITLE[1])} THEN '{name}'" for name, _, _, words in V.CRAWL_ERRORS)
    + " ELSE 'unknown' END AS error_type, CASE "
    + " ".join(f"WHEN {any_sql(words, TEXT_TITLE[1])} THEN '{how}'" for _, _, how, words in V.CRAWL_ERRORS)
    + " ELSE 'default_retry' END AS strategy FROM contents"
)
def crawl_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents(spark, sf_dir).select("id", classify.crawl_error(F.col("content"), F.col("platform")).alias("e"))
    return found.select("id", F.col("e.type").alias("error_type"), F.col("e.strategy").alias("strategy"))


@query(f"WITH {CONTENTS_SQL} SELECT id FROM contents WHERE {BASIC_SQL}")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).filter(classify.basic_quality(F.col("title"), F.col("content"))).select("id")


@query(
    f"""WITH {CONTENTS_SQL}, fine AS (SELECT *, CAST({RELEVANCE_SQL} AS BIGINT) AS score, row_number() OVER (ORDER BY pos) AS rn
      FROM contents WHERE {BASIC_SQL}) SELECT id, score FROM fine WHERE score > 0 OR rn <= 3"""
)
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = contents(spark, sf_dir).filter(classify.basic_quality(F.col("title"), F.col("content")))
    return dedup.relevant(fine, "the").select("id", "score")


WORTH_SQL = f"""(length({trimmed("title")}) >= 3 AND length({trimmed("content")}) >= 20 AND NOT {any_sql(V.REJECT_WORDS, *TEXT_TITLE)}
  AND NOT ({any_sql(V.LOGIN_WORDS, TEXT_TITLE[0])} AND length({trimmed("content")}) < 200))"""


@query(
    f"""WITH {CONTENTS_SQL} SELECT l.quality, {WORTH_SQL} AS worth, {BASIC_SQL} AS basic, count(*) AS n
    FROM contents JOIN labels l ON l.doc_id = contents.id GROUP BY ALL"""
)
def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = F.col("title"), F.col("content")
    judged = contents(spark, sf_dir).select(
        "id", classify.worth_processing(title, content).alias("worth"), classify.basic_quality(title, content).alias("basic")
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return judged.join(labels, "id").groupBy("quality", "worth", "basic").agg(F.count("*").alias("n"))


GREEDY_SQL = f"""WITH RECURSIVE {CONTENTS_SQL},
 p AS (SELECT CAST(pos // 30 AS BIGINT) AS batch_id, pos, url, md5(lower({trimmed("title || content")})) AS content_hash,
   row_number() OVER (PARTITION BY pos // 30 ORDER BY pos) AS k FROM contents WHERE {BASIC_SQL}),
 r AS (SELECT batch_id, pos, url, content_hash, k, true AS kept, [url] AS urls, [content_hash] AS hashes FROM p WHERE k = 1
   UNION ALL SELECT p.batch_id, p.pos, p.url, p.content_hash, p.k, NOT (list_contains(urls, p.url) OR list_contains(hashes, p.content_hash)),
     CASE WHEN list_contains(urls, p.url) OR list_contains(hashes, p.content_hash) THEN urls ELSE list_append(urls, p.url) END,
     CASE WHEN list_contains(urls, p.url) OR list_contains(hashes, p.content_hash) THEN hashes ELSE list_append(hashes, p.content_hash) END
   FROM r JOIN p ON p.batch_id = r.batch_id AND p.k = r.k + 1)
SELECT batch_id, pos, url, content_hash FROM r WHERE kept"""


@query(GREEDY_SQL)
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = F.col("title"), F.col("content")
    posts = contents(spark, sf_dir).filter(classify.basic_quality(title, content))
    batch = F.floor(F.col("pos") / 30).alias("batch_id")
    hashed = posts.select(batch, "pos", "url", text.content_md5(title, content).alias("content_hash"))
    return dedup.greedy(hashed)


@query(
    f"""WITH {CONTENTS_SQL}, h AS (SELECT *, sha256(content) AS content_hash FROM contents),
      history AS (SELECT * FROM h WHERE id % 3 = 0), batch AS (SELECT * FROM h WHERE id % 3 <> 0),
      a AS (SELECT * FROM batch WHERE content_hash NOT IN (SELECT content_hash FROM history)
        AND NOT EXISTS (SELECT 1 FROM history x WHERE x.url <> '' AND x.url = batch.url AND x.platform = batch.platform)),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY pos) = 1)
    SELECT id, content_hash FROM b QUALIFY row_number() OVER (PARTITION BY url, platform ORDER BY pos) = 1"""
)
def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = contents(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256))
    found = dedup.new_contents(hashed.filter("id % 3 <> 0"), hashed.filter("id % 3 = 0"))
    return found.select("id", "content_hash")


@query(
    f"WITH {CONTENTS_SQL} SELECT content_hash, count(*) AS n FROM (SELECT sha256(content) AS content_hash FROM contents) GROUP BY 1 HAVING count(*) > 1"
)
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = contents(spark, sf_dir).select(F.sha2("content", 256).alias("content_hash"))
    return dedup.violations(hashed, ["content_hash"])
