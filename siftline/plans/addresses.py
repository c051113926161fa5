"""Queries over addresses, links and texts of pages and documents, and over the times of events.

The hosts of the tables' pages belong to no platform, so pages are read here as if a platform's site served their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import classify, text, times, urls
from siftline.functions import vocabulary as V
from siftline.operators import search
from siftline.plans.content import STRIP_SQL, any_sql, noise_sql, trimmed
from siftline.plans.registry import AS_OF, CONTENTS_SQL, PLATFORMS, as_of, contents, query
from siftline.sources.tables import table

#: Places of platforms below which pages are taken to lie, by the page's id.
SITES = [
    "weibo.com", "weibo.com/u", "weibo.com/status", "weibo.cn/热点新闻", "www.bilibili.com/video", "space.bilibili.com/space",
    "b23.tv", "www.xiaohongshu.com/explore", "xhslink.com", "www.douyin.com/user", "www.douyin.com/search", "news.example.com/home",
]


def listed_sql(values: list[str], k: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({k}) % {len(values)} AS INTEGER) + 1)"


def listed(values: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


ADDRESSES_SQL = f"""addresses AS (SELECT page_id, url, html, {listed_sql(PLATFORMS, "page_id")} AS platform,
  'https://' || {listed_sql(SITES, "page_id")} || regexp_extract(url, '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS address FROM pages)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a platform and an address on a platform's site; path and query are the page's own."""
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", listed(PLATFORMS, page).alias("platform"), F.concat(F.lit("https://"), listed(SITES, page), path).alias("address")
    )


def cases_sql(column: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN '{then}'" for when, then in rules) + f" ELSE '{default}' END AS {column}"


def on_sql(site: str, *parts: str) -> str:
    held = f"contains(lower(address), '{site}')"
    return f"{held} AND {any_sql(list(parts), 'lower(address)')}" if parts else held


KINDS_SQL = cases_sql(
    "kind",
    [
        (on_sql("weibo.com", "/home", "tabtype=feed", "is_all=1"), "微博动态页面"),
        (on_sql("weibo.com", "/u/", "/n/"), "微博用户页面"),
        (on_sql("weibo.com"), "微博首页或其他页面"),
        (on_sql("bilibili.com", "/video/"), "B站视频页面"),
        (on_sql("bilibili.com", "/space/"), "B站用户空间"),
        (on_sql("bilibili.com"), "B站首页或其他页面"),
        (on_sql("xiaohongshu.com", "/explore/", "/user/"), "小红书动态页面"),
        (on_sql("xiaohongshu.com"), "小红书首页或其他页面"),
        (on_sql("douyin.com", "/user/", "/video/"), "抖音动态页面"),
        (on_sql("douyin.com"), "抖音首页或其他页面"),
    ],
    "未知平台页面",
)
SERVICES_SQL = cases_sql(
    "service",
    [
        ("regexp_matches(address, 'weibo[.](com|cn)')", "weibo"),
        ("regexp_matches(address, 'bilibili[.]com|b23[.]tv')", "bilibili"),
        ("regexp_matches(address, 'xiaohongshu[.]com|xhslink[.]com')", "xiaohongshu"),
        ("regexp_matches(address, 'douyin[.]com')", "douyin"),
    ],
    "general",
)


@query(f"WITH {ADDRESSES_SQL} SELECT page_id, {KINDS_SQL}, {SERVICES_SQL}, CAST(CASE WHEN regexp_matches(lower(address), 'search|topic|hashtag') THEN 20 ELSE 10 END AS BIGINT) AS rounds FROM addresses")
def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    return addresses(spark, sf_dir).select("page_id", urls.url_type(a).alias("kind"), urls.service_of(a).alias("service"), urls.scroll_rounds(a).cast("long").alias("rounds"))


PARTS_SQL = "list_filter(string_split({}, '/'), lambda x: length(x) > 2 {})"


@query(
    f"""WITH {ADDRESSES_SQL} SELECT page_id,
    coalesce({PARTS_SQL.format("address", "AND x NOT IN ('http:', 'https:', 'www', 'weibo', 'com')")}[1], '热门微博') AS wanted,
    {PARTS_SQL.format("regexp_extract(address, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)", "")}[1] AS news,
    coalesce({PARTS_SQL.format("address", "AND NOT regexp_matches(x, '^[0-9]+$') AND regexp_matches(x, '[一-鿿]')")}[1], '热点') AS chinese FROM addresses"""
)
def address_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    return addresses(spark, sf_dir).select(
        "page_id", urls.query_of(a, "weibo").alias("wanted"), urls.news_query(a).alias("news"), urls.chinese_query(a, "热点").alias("chinese")
    )


@query(
    """WITH l AS (SELECT page_id, url, regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1) AS links FROM pages),
    u AS (SELECT page_id, url, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS k FROM l)
    SELECT page_id, CAST(k AS BIGINT) AS k, CASE WHEN starts_with(link, '//') THEN 'https:' || link
      WHEN starts_with(link, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || link ELSE link END AS target FROM u"""
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link and picture of a page by its whole address."""
    links = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links).alias("k", "link"))
    return found.select("page_id", F.col("k").cast("long").alias("k"), urls.absolute(F.col("link"), F.col("url")).alias("target"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract(text, '\pL+') AS word FROM documents), q AS (SELECT doc_id, url_encode(word) || '+site%3Abilibili.com' AS q FROM w)
    SELECT doc_id, 'https://www.baidu.com/s?wd=' || q AS baidu, 'https://www.sogou.com/web?query=' || q AS sogou, 'https://www.bing.com/search?q=' || q AS bing FROM q"""
)
def engine_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each engine is asked for a document's first word."""
    found = urls.search_addresses(F.regexp_extract("text", r"\pL+", 0), "bilibili")
    docs = table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))
    return docs.select("doc_id", *(F.get("found", F.lit(k)).alias(name) for k, name in enumerate(urls.SEARCH_ENGINES)))


@query(
    rf"""SELECT page_id, md5({trimmed("regexp_replace(regexp_replace(html, '<br[ ]*/?>', chr(10), 'g'), '[[:space:]]+', ' ', 'g')")}) AS broken,
    md5(array_to_string(list_filter(list_transform(regexp_split_to_array(html, '\n|  '), lambda x: {trimmed('x')}), lambda x: x <> ''), chr(10))) AS lines FROM pages"""
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.break_lines(h)).alias("broken"), F.md5(text.text_lines(h)).alias("lines"))


SPANS_SQL = noise_sql("'三连' || title || '支持 ' || content", V.BILIBILI_SPANS, "")


@query(
    f"WITH {CONTENTS_SQL}, s AS (SELECT id, {SPANS_SQL} AS c FROM contents), g AS (SELECT id, {noise_sql(STRIP_SQL.replace('html', 'c'), V.NOISE)} AS c FROM s),"
    f" p AS (SELECT id, {noise_sql('c', V.PLATFORM_NOISE['bilibili'])} AS c FROM g), t AS (SELECT id, "
    + trimmed(r"regexp_replace(c, '\s+', ' ', 'g')")
    + " AS c FROM p) SELECT id, CASE WHEN length(c) < 10 THEN '' ELSE c END AS clean FROM t"
)
def clean_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents behind a call for likes, as texts of videos have it."""
    given = F.concat(F.lit("三连"), F.col("title"), F.lit("支持 "), F.col("content"))
    return contents(spark, sf_dir).select("id", text.clean_bilibili(given).alias("clean"))


LEADING_SQL = " ".join(f"WHEN '{p}' THEN [{', '.join(repr(t) for t in own)}]" for p, own in text.LEADING_TAGS.items())


@query(
    rf"""WITH {CONTENTS_SQL}, t AS (SELECT id, list_concat(list_append(CASE platform {LEADING_SQL} END, author), regexp_extract_all(content, '#([^#\s]+)#?', 1)) AS tags FROM contents)
    SELECT id, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), '|') AS tags FROM t"""
)
def request_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of contents found by a request, which is the content's author here."""
    by = {p: text.leading_tags(F.col("content"), F.col("author"), p) for p in text.LEADING_TAGS}
    return contents(spark, sf_dir).select("id", F.array_join(by_platform(by), "|").alias("tags"))


def by_platform(by: dict[str, Column]) -> Column:
    found = None
    for p, c in by.items():
        found = (F if found is None else found).when(F.col("platform") == p, c)
    return found


SERVICE_AUTHORS_SQL = " ".join(f"WHEN '{p}' THEN '{a}'" for p, a in V.SERVICE_AUTHORS.items())
RESULT_AUTHORS_SQL = " ".join(f"WHEN '{p}' THEN '{a}'" for p, a in V.RESULT_AUTHORS.items())


@query(
    rf"""WITH {CONTENTS_SQL} SELECT id, CASE WHEN regexp_matches(title || ' ' || content, '@[^@\s]') THEN regexp_extract(title || ' ' || content, '@([^@\s]+)')
      WHEN platform = 'bilibili' AND contains(title || ' ' || content, 'UP主') THEN regexp_extract(title || ' ' || content, 'UP主([^：\s]*)')
      ELSE CASE platform {SERVICE_AUTHORS_SQL} END END AS of_service,
    CASE WHEN platform <> 'news' THEN coalesce(nullif(regexp_extract(title, '@[^@\s]+'), ''), CASE platform {RESULT_AUTHORS_SQL} END) END AS of_title FROM contents"""
)
def result_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    of_title = by_platform({p: search.title_author(t, p) for p in V.RESULT_AUTHORS})
    of_service = search.service_author(t, F.col("content"), F.col("platform"))
    return contents(spark, sf_dir).select("id", of_service.alias("of_service"), of_title.alias("of_title"))


FILE_SQL = "'see ' || address || CASE page_id % 3 WHEN 0 THEN '/x.MP4' WHEN 1 THEN '.webm?x' ELSE '' END || ' now'"


@query(
    rf"""WITH {ADDRESSES_SQL}, f AS (SELECT page_id, platform, address, {FILE_SQL} AS s FROM addresses)
    SELECT page_id, coalesce(nullif(regexp_extract(s, '(?i)https?://[^\s]+\.(mp4|avi|mov|wmv|flv|webm)'), ''), nullif(regexp_extract(s, '(?i)https?://v\.douyin\.com/[^\s]+'), ''),
      nullif(regexp_extract(s, '(?i)https?://www\.bilibili\.com/video/[^\s]+'), ''), nullif(regexp_extract(s, '(?i)https?://video\.weibo\.com/[^\s]+'), '')) AS video,
    CASE WHEN platform IN ('douyin', 'bilibili') AND (contains(lower(address), 'video') OR contains(address, 'bilibili.com') OR contains(address, 'douyin.com')) THEN address ELSE '' END AS of_result FROM f"""
)
def video_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos that a text about a page and the page's address point to."""
    a, kind = F.col("address"), F.col("page_id") % 3
    given = F.concat(F.lit("see "), a, F.when(kind == 0, "/x.MP4").when(kind == 1, ".webm?x").otherwise(""), F.lit(" now"))
    return addresses(spark, sf_dir).select("page_id", text.video_url(given).alias("video"), text.result_video(a, F.col("platform")).alias("of_result"))


HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"


@query(
    rf"""WITH h AS (SELECT page_id, html, regexp_extract(html, '{HEADING}', 1) AS heading, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages),
    c AS (SELECT *, CASE WHEN length(heading) > 50 THEN heading WHEN length('# ' || title || ' ' || heading) > 50 THEN '# ' || title || ' ' || heading ELSE {STRIP_SQL} END AS found FROM h)
    SELECT page_id, md5(CASE WHEN length(found) < 100 THEN substring(html, 1, 3000) ELSE found END) AS content,
    regexp_replace(regexp_replace(CASE WHEN length(heading) % 30 >= 5 THEN substring(heading, 1, length(heading) % 30) ELSE coalesce(nullif(title, ''), '未知标题') END,
      '[-_|].*?(微博|bilibili|小红书|抖音).*?$', ''), '^\s+|\s+$', '', 'g') AS title FROM c"""
)
def best_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content and the title that are chosen of what a page gives: its heading, its title and its text."""
    h = F.col("html")
    given = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("html", HEADING, 1).alias("heading"))
    marked = F.concat(F.lit("# "), text.page_title(h), F.lit(" "), F.col("heading"))
    cut = F.col("heading").substr(F.lit(1), F.char_length("heading") % 30)
    return given.select("page_id", F.md5(text.best_content(F.col("heading"), marked, h)).alias("content"), text.best_title(cut, h).alias("title"))


@query(
    rf"""WITH {ADDRESSES_SQL}, p AS (SELECT page_id, platform, list_filter(string_split(regexp_extract(address, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
      regexp_extract(address, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM addresses),
    n AS (SELECT *, list_filter(parts, lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS named FROM p)
    SELECT page_id, coalesce(CASE platform WHEN 'weibo' THEN CASE WHEN contains(path, '/u/') THEN '微博用户动态' WHEN contains(path, '/status/') THEN '微博动态' END
      WHEN 'bilibili' THEN CASE WHEN contains(path, '/video/') THEN 'B站视频' WHEN contains(path, '/space/') THEN 'B站用户空间' END
      WHEN 'xiaohongshu' THEN '小红书笔记' WHEN 'douyin' THEN '抖音视频' END,
    CASE WHEN len(named) > 0 THEN platform || '内容 - ' || substring(named[-1], 1, 20) ELSE platform || '内容' END) AS title FROM n"""
)
def address_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for a page by its address: the platform's own, else one made of the path."""
    title = by_platform({p: search.url_title(F.col("address"), p) for p in PLATFORMS})
    return addresses(spark, sf_dir).select("page_id", title.alias("title"))


NUMBER_SQL = r"CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


def number() -> Column:
    """The number in an event's properties."""
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 8 HOUR WHEN 'error' THEN date_trunc('second', ts)
      WHEN 'view' THEN date_trunc('second', ts) + INTERVAL 210 MINUTE END AS at FROM events"""
)
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events as records give them with a zone; the rest have none, and no time."""
    kind = F.col("event_type")
    zone = F.when(kind == "click", "+08:00").when(kind == "error", "Z").when(kind == "view", "-03:30").otherwise("")
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", times.zoned_time(written).alias("at"))


@query(
    f"""SELECT event_id, CASE WHEN {NUMBER_SQL} % 8 < 5 THEN date_trunc('second', ts) WHEN {NUMBER_SQL} % 8 < 7 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS at FROM events"""
)
def times_of_all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events, written in each format that is read, or in none."""
    written = F.lit("no time")
    for k, f in enumerate(times.FORMATS):
        written = F.when(number() % 8 == k, F.date_format("ts", f)).otherwise(written)
    return table(spark, sf_dir, "events").select("event_id", times.parse_time(written).alias("at"))


@query(f"SELECT event_id, CASE WHEN event_type = 'error' THEN 86400 ELSE greatest(date_sub('second', TIMESTAMP '{AS_OF}', ts + to_days({NUMBER_SQL})), 60) END AS seconds FROM events")
def cache_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long what events stored may be kept; errors never expire by themselves."""
    expires = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(days=number())
    left = times.cache_seconds(F.when(F.col("event_type") != "error", expires), as_of())
    return table(spark, sf_dir, "events").select("event_id", left.alias("seconds"))


KINDS = [*V.RETRY_TIMEOUTS, "navigation", "unknown"]
STRATEGIES = [*V.RETRY_WAITS, "none"]
WAITS_SQL = " ".join(f"WHEN '{k}' THEN {list(w)}" for k, w in V.RETRY_WAITS.items()) + f" ELSE {list(V.RETRY_WAITS['default_retry'])}"
TIMEOUTS_SQL = " ".join(f"WHEN '{k}' THEN {a} + {b} * attempt" for k, (a, b, *_) in V.RETRY_TIMEOUTS.items())
DELAYS_SQL = " ".join(f"WHEN '{k}' THEN {a} + {b} * attempt" for k, (*_, a, b) in V.RETRY_TIMEOUTS.items())


@query(
    f"""WITH e AS (SELECT event_id, {listed_sql(STRATEGIES, NUMBER_SQL)} AS strategy, {listed_sql(KINDS, NUMBER_SQL)} AS kind, {listed_sql(PLATFORMS, "user_id")} AS platform, {NUMBER_SQL} // 8 % 5 AS attempt FROM events),
    w AS (SELECT *, (CASE strategy {WAITS_SQL} END)[least(attempt, 2) + 1] AS wait_s, CASE kind {TIMEOUTS_SQL} ELSE {[t for t, _ in V.OTHER_TIMEOUTS]}[least(attempt, 2) + 1] END AS t,
      CASE kind {DELAYS_SQL} ELSE {[d for _, d in V.OTHER_TIMEOUTS]}[least(attempt, 2) + 1] END AS d FROM e)
    SELECT event_id, wait_s, CAST(CASE WHEN platform = 'news' THEN t ELSE t * 3 // 2 END AS BIGINT) AS timeout_ms, CAST(CASE WHEN platform = 'news' THEN d ELSE d * 1.2 END AS DOUBLE) AS delay_s FROM w"""
)
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits and limits of retries; strategy, kind of error and attempt come of an event's number, the platform of its user."""
    attempt = F.floor(number() / 8).cast("int") % 5
    limits = classify.retry_limits(listed(KINDS, number()), attempt, listed(PLATFORMS, F.col("user_id")))
    found = table(spark, sf_dir, "events").select(
        "event_id", classify.retry_wait(listed(STRATEGIES, number()), attempt).alias("wait_s"), limits.alias("limits")
    )
    return found.select("event_id", "wait_s", "limits.*")


@query(
    """WITH s AS (SELECT page_id, CASE WHEN contains(html, '<table') OR contains(html, '<form') OR regexp_extract(lower(url), '://([^/?#]*)', 1) LIKE 'm.%' THEN 'browser' ELSE 'local' END AS first,
      length(html) < 3000 AS failed FROM pages)
    SELECT page_id, CASE WHEN NOT failed THEN first WHEN first = 'browser' THEN 'local' ELSE 'browser' END AS service, CASE WHEN failed THEN first END AS fallback_from FROM s"""
)
def fetch_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which service gives a page: tables, a form or a mobile host want the browser; a short page is a failure."""
    h, host = F.col("html"), urls.url_host(F.col("url"))
    selector = F.when(F.contains(h, F.lit("<form")), "form")
    wait = F.when(F.startswith(host, F.lit("m.")), "networkidle")
    first = classify.fetch_service(F.contains(h, F.lit("<table")), selector, host, wait, [])
    found = classify.fallback_service(first, F.char_length(h) < 3000)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("found")).select("page_id", "found.*")
