"""Queries over search results, pages and their request logs.

Result pages are made of documents: a title of letters and blanks, an address and a snippet in the markup of an engine.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import classify, html
from siftline.functions import vocabulary as V
from siftline.operators import dedup, search, stats
from siftline.plans.content import any_sql, count_sql
from siftline.plans.registry import AS_OF, as_of, query
from siftline.sources.shared import stored
from siftline.sources.tables import table

#: Titles of 60 characters and all the rest, without any sign of markup, and an address by the id.
PLAIN_SQL = r"trim(regexp_replace({}, '[^A-Za-z0-9#@]+', ' ', 'g'))"
RESULTS_SQL = f"""results AS (SELECT doc_id AS page_id, {PLAIN_SQL.format("substring(text, 1, 60)")} AS title, 'https://example.com/video/' || doc_id AS url,
  {PLAIN_SQL.format("substring(text, 61)")} AS snippet, list_extract(['weibo', 'douyin', 'xiaohongshu', 'bilibili'], CAST(doc_id % 4 AS INTEGER) + 1) AS platform FROM documents)"""
#: Every 210 characters of a text are a result: 60 of title, 150 of snippet.
PASSAGES_SQL = f"""cuts AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // 210)) AS part FROM documents),
  passages AS (SELECT doc_id AS page_id, {PLAIN_SQL.format("substring(text, part * 210 + 1, 60)")} AS title, 'https://example.com/video/' || doc_id || '-' || part AS url,
  {PLAIN_SQL.format("substring(text, part * 210 + 61, 150)")} AS snippet FROM cuts)"""


#: Letters one by one: of such a class Java makes a table of bits, of ranges a chain of tests, which took nine times as long.
NO_SIGN = f"[^{string.ascii_letters}{string.digits}#@]+"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NO_SIGN, " "))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["weibo", "douyin", "xiaohongshu", "bilibili"]))
    # generated columns are worked out once; plain ones would be again wherever a filter or a rule reads them
    plain = F.inline(F.array(F.struct(_plain(F.substring("text", 1, 60)).alias("title"), _plain(F.expr("substring(text, 61)")).alias("snippet"))))
    return table(spark, sf_dir, "documents").select("doc_id", plain).select(
        F.col("doc_id").alias("page_id"),
        "title",
        F.concat(F.lit("https://example.com/video/"), F.col("doc_id").cast("string")).alias("url"),
        "snippet",
        F.get(names, (F.col("doc_id") % 4).cast("int")).alias("platform"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # cut by one match after another: by places, every cut would walk the text from its beginning
    each = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,210}|^$"), 0)).alias("part", "cut")
    return table(spark, sf_dir, "documents").select("doc_id", each).select(
        F.col("doc_id").alias("page_id"),
        _plain(F.substring("cut", 1, 60)).alias("title"),
        F.concat_ws("-", F.concat(F.lit("https://example.com/video/"), F.col("doc_id").cast("string")), F.col("part").cast("string")).alias("url"),
        _plain(F.expr("substring(cut, 61)")).alias("snippet"),
    )


def _page(body: str):
    """HTML by a template in which {title}, {url} and {snippet} stand for columns."""
    page = F.lit(body)
    for name in ("title", "url", "snippet"):
        page = F.replace(page, F.lit("{" + name + "}"), F.col(name))
    return page


ENGINE_PAGES = {
    "baidu": '<div class="result c-container"><h3 class=t><a href="{url}">{title}</a></h3><div class="c-abstract"> {snippet} </div></div><div class="result"><h3><a href="no">no</a></h3></div>',
    "sogou": '<div class=results><div class=result><p class=title><a href="{url}">{title}</a></p><div class=content>{snippet}</div></div></div>',
    "bing": '<ol><li class="b_algo x"><h2><a href="{url}">{title}</a></h2><div class=b_caption><p>{snippet}</p></div></li></ol>',
}


def _engine_query(engine: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = results(spark, sf_dir).select("page_id", "url", _page(f"<html><body>{ENGINE_PAGES[engine] * 2}</body></html>").alias("html"))
        found = search.results_of(pages, engine)
        return found.select("page_id", F.col("rank").cast("long").alias("rank"), "title", "url", "snippet")

    run.__name__ = f"search_results_{engine}"
    return run


for _engine in ENGINE_PAGES:
    query(
        f"""WITH {RESULTS_SQL}, r AS (SELECT unnest([0, 1]) AS rank)
    SELECT page_id, CAST(rank AS BIGINT) AS rank, title, url, snippet FROM results, r WHERE title <> ''"""
    )(_engine_query(_engine))


@query(
    rf"""WITH {PASSAGES_SQL} SELECT page_id, title, url, CASE WHEN length(snippet) >= 20 THEN snippet ELSE '' END AS snippet FROM passages WHERE title <> ''"""
)
def linked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = passages(spark, sf_dir).filter("title <> ''").withColumn("html", _page('<h3 class=x><a href="{url}" target=y>{title}</a></h3><p>{snippet}</p>'))
    found = pages.select("page_id", F.inline(search.linked_titles(F.col("html"))))
    return found.select("page_id", "title", "url", "snippet")


@query(
    rf"""WITH {PASSAGES_SQL} SELECT page_id, title, url, '{V.RESULT_TEXT}' AS snippet FROM passages WHERE length(title) > 5"""
)
def linked_titles_without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = passages(spark, sf_dir).withColumn("html", _page('<p><a href="{url}">{title}</a><a href="/x">登录 {title}</a></p>'))
    found = pages.select("page_id", F.inline(search.linked_titles(F.col("html"))))
    return found.select("page_id", "title", "url", "snippet")


def _records_sql() -> str:
    parts = []
    for p, (static, paths, _, dynamic, least, between) in classify.RESULT_RULES.items():
        both = f"lower(title || '{between}' || snippet)"
        tags = ", ".join(f"'{t}'" for t in [*V.RESULT_TAGS[p], "the"])
        found = f"list_concat([{tags}], list_slice(regexp_extract_all(title || snippet, '#([^#\\s]+)#?', 1), 1, 3))" if p != "bilibili" else f"[{tags}]"
        related = f" AND {any_sql([*V.RESULT_WORDS[p], 'the'], 'lower(title || snippet)')}" if p in V.RESULT_WORDS else ""
        name = r"@[^@\s]+|UP主[^：\s]*" if p == "bilibili" else r"@[^@\s]+"
        video = "url" if p in ("douyin", "bilibili") else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"""SELECT page_id, '{p}' AS platform, title, coalesce(nullif(regexp_extract(title, '{name}'), ''), '{V.RESULT_AUTHORS[p]}') AS author,
      substring(CASE WHEN snippet <> '' THEN snippet ELSE '{V.RESULT_LEADS[p]}' || title END, 1, 800) AS content, {found} AS tags, {video} AS video_url
    FROM results WHERE platform = '{p}' AND NOT {any_sql(static, both)} AND NOT {any_sql(paths, "lower(url)")} AND {count_sql(dynamic, both)} >= {least}{related}"""
        )
    rows = " UNION ALL ".join(parts)
    distinct = "list_filter(tags, lambda x, i: list_position(tags, x) = i)"
    return f"WITH {RESULTS_SQL}, r AS ({rows}) SELECT * EXCLUDE (tags), array_to_string({distinct}, '|') AS tags FROM r"


def _talked_of(df: DataFrame) -> DataFrame:
    """Every other snippet gets words that the platforms' rules ask for."""
    return df.withColumn("snippet", F.when(F.col("page_id") % 2 == 0, F.concat("snippet", F.lit(" 视频 分享 #a #b"))).otherwise(F.col("snippet")))


@query(_records_sql().replace("AS snippet,", "|| CASE WHEN doc_id % 2 = 0 THEN ' 视频 分享 #a #b' ELSE '' END AS snippet,"))
def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.all_posts(_talked_of(results(spark, sf_dir)), "the")
    return found.select("page_id", "platform", "title", "author", "content", F.array_join("tags", "|").alias("tags"), "video_url")


@query(
    f"""WITH {RESULTS_SQL}, n AS (SELECT *, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Daily' ELSE repeat('x', 60) END AS source,
      CASE WHEN page_id % 2 = 0 THEN '3小时前' ELSE '' END AS time FROM results)
    SELECT page_id, title, url, CASE source WHEN '' THEN '{V.NEWS_SOURCES["without"]}' WHEN 'Daily' THEN source ELSE '{V.NEWS_SOURCES["too_long"]}' END AS author,
      substring(CASE WHEN snippet <> '' THEN snippet ELSE '{V.RESULT_LEADS["news"]}' || title END, 1, 1000) AS content, '新闻|资讯|the' AS tags,
      CASE WHEN time <> '' THEN TIMESTAMP '{AS_OF}' - INTERVAL 3 HOUR END AS published_at
    FROM n WHERE length(title) > 10 AND NOT {any_sql(V.NEWS_EXCLUDED, "lower(title)")}"""
)
def news_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "Daily").otherwise("x" * 60)
    given = results(spark, sf_dir).withColumns({"source": source, "time": F.when(F.col("page_id") % 2 == 0, "3小时前").otherwise("")})
    found = search.news_posts(given, "the", as_of())
    return found.select("page_id", "title", "url", "author", "content", F.array_join("tags", "|").alias("tags"), "published_at")


@query(
    f"""WITH {RESULTS_SQL} SELECT page_id, CAST(1 AS BIGINT) AS rank, title, 'https://site.com/n/' || page_id AS url FROM results
    WHERE length(title) > 10 AND length(title) < 100 AND contains(lower(title), 'the')"""
)
def news_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('<a href="https://x.y">short</a><a href="/n/'), F.col("page_id").cast("string"), F.lit('"> '), "title", F.lit(" </a><p>"), "snippet", F.lit("</p><a href=q>the the the the</a>"))
    pages = results(spark, sf_dir).select("page_id", F.lit("https://site.com/a/b").alias("url"), body.alias("html"))
    return search.news_links(pages, "the").select("page_id", F.col("rank").cast("long").alias("rank"), "title", "url")


@query(
    f"""WITH {RESULTS_SQL} SELECT page_id, CASE WHEN page_id % 3 = 0 AND title <> '' AND length(title) < 50 THEN title WHEN page_id % 3 = 1 THEN 'By Name'
      WHEN page_id % 2 = 0 THEN '微博用户' ELSE '未知作者' END AS author FROM results"""
)
def page_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>"), "snippet", F.lit("</p><b class=author>"), "title", F.lit("</b>"))).when(
        F.col("page_id") % 3 == 1, F.lit("<i class='x co-writer'>By</i><a rel=author> By Name</a>")
    ).otherwise("<p>none</p>")
    url = F.when(F.col("page_id") % 2 == 0, "https://weibo.com/1").otherwise("https://a.b")
    return search.page_author(results(spark, sf_dir).select("page_id", url.alias("url"), own.alias("html")))


@query(
    f"""WITH {RESULTS_SQL} SELECT page_id, title, 'a|b' AS tags, '' AS missing, '## ' || title || chr(10) || chr(10) || 'x **y** [z](/q) ' || snippet || chr(10) || chr(10) || '- i' AS markdown
    FROM results WHERE title <> '' AND snippet <> ''"""
)
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = results(spark, sf_dir).filter("title <> '' and snippet <> ''").withColumn(
        "html", F.concat(F.lit("<h2>"), "title", F.lit("</h2><p>x <b>y</b> <a href=/q>z</a> "), "snippet", F.lit("</p><ul class=s><li>i</li></ul>"))
    )
    tagged = pages.withColumn("html", F.concat("html", F.lit("<script>var a</script>")))
    fields = html.page_fields(pages.withColumn("html", F.concat("html", F.lit("<i class=t>a</i><i class=t>b</i>"))), {"title": "h2", "tags": ".t", "missing": "#no"})
    found = fields.select("page_id", F.col("one")["title"].alias("title"), F.array_join(F.col("many")["tags"], "|").alias("tags"), F.col("one")["missing"].alias("missing"))
    return found.join(html.page_markdown(tagged), "page_id")


@query(f"WITH {RESULTS_SQL} SELECT page_id, snippet AS content FROM results WHERE snippet <> ''")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of content by the fixed order, whatever stands before it; a selector without a hit changes nothing."""
    body = F.concat(F.lit("<div class=content>no</div><nav><main>no</main></nav><article>no</article><main><header>no</header>"), "snippet", F.lit("<aside>no</aside></main>"))
    pages = results(spark, sf_dir).filter("snippet <> ''").select("page_id", "url", body.alias("html"))
    return html.page_extract(pages, css=".nothing").select("page_id", "content")


@query(
    f"""WITH {RESULTS_SQL} SELECT page_id, title || ' ' || snippet AS content FROM results WHERE title <> '' AND snippet <> ''"""
)
def page_selected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<main>no</main><p class='a pick'> "), "title", F.lit(" </p><p class=pick>"), "snippet", F.lit("</p><p class=pick2>no</p>"))
    pages = results(spark, sf_dir).filter("title <> '' and snippet <> ''").select("page_id", "url", body.alias("html"))
    return html.page_extract(pages, css="p.pick").select("page_id", "content")


@query(
    f"""WITH {RESULTS_SQL} SELECT page_id, title || 'k' || CASE WHEN len(string_split(title, ' ')) < 10 THEN snippet ELSE '' END AS content, CAST(1 AS BIGINT) AS n_links FROM results"""
)
def page_crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short content gives way to all that is left of the page, and links are those left."""
    from siftline.operators import records

    body = F.concat(F.lit("<nav><a href=/n>no</a></nav><main>"), "title", F.lit("<a href=/k>k</a></main><p>"), "snippet", F.lit("</p><footer>no</footer>"))
    pages = results(spark, sf_dir).select("page_id", "url", body.alias("html"))
    return records.crawled(pages).select("page_id", "content", F.size("links").cast("long").alias("n_links"))


REQUESTS_SQL = """requests AS (SELECT event_id, user_id AS page_id, list_extract(['weibo', 'bilibili', 'news'], CAST(user_id % 3 AS INTEGER) + 1) AS platform,
    list_extract(['xhr', 'image', 'script', 'document'], CAST(event_id % 4 AS INTEGER) + 1) AS resource_type, CASE WHEN event_id % 10 = 0 THEN 'post' ELSE 'GET' END AS method,
    list_extract(['https://weibo.com/ajax/x', 'https://a.b/api/y', 'https://a.b/Captcha', 'https://bilibili.com/x/space/1', 'https://passport.weibo.com', 'https://i.hdslb.com/1', 'https://a.b'],
      CAST(event_id % 7 AS INTEGER) + 1) AS url,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 500 END ELSE 200 END AS status_code, value * 1000 AS response_time FROM events),
  messages AS (SELECT user_id AS page_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'warning' ELSE 'log' END AS type,
    CASE WHEN event_id % 11 = 0 THEN 'Bot Detected!' ELSE 'x' END AS text FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def pick(number: str, values: list[str]):
        return F.get(F.array(*map(F.lit, values)), (F.col(number) % len(values)).cast("int"))

    events = table(spark, sf_dir, "events")
    urls = ["https://weibo.com/ajax/x", "https://a.b/api/y", "https://a.b/Captcha", "https://bilibili.com/x/space/1", "https://passport.weibo.com", "https://i.hdslb.com/1", "https://a.b"]
    error = F.col("event_type") == "error"
    sent = events.select(
        "event_id",
        F.col("user_id").alias("page_id"),
        pick("user_id", ["weibo", "bilibili", "news"]).alias("platform"),
        pick("event_id", ["xhr", "image", "script", "document"]).alias("resource_type"),
        F.when(F.col("event_id") % 10 == 0, "post").otherwise("GET").alias("method"),
        pick("event_id", urls).alias("url"),
        F.when(error, F.when(F.col("event_id") % 2 == 0, 429).otherwise(500)).otherwise(200).alias("status_code"),
        (F.col("value") * 1000).alias("response_time"),
    )
    told = events.select(
        F.col("user_id").alias("page_id"),
        F.when(error, "Error").when(F.col("event_type") == "click", "warning").otherwise("log").alias("type"),
        F.when(F.col("event_id") % 11 == 0, "Bot Detected!").otherwise("x").alias("text"),
    )
    return sent, told


FLAGS_SQL = """flags AS (SELECT *, status_code >= 400 AS failed, resource_type = 'xhr' OR method = 'post' AS xhr FROM requests)"""


@query(
    f"""WITH {REQUESTS_SQL}, {FLAGS_SQL}, r AS (SELECT page_id, count(*) AS total, count(*) FILTER (failed) AS failed, count(*) FILTER (xhr) AS xhr,
      count(*) FILTER (xhr AND (contains(url, '/api/') OR contains(url, '/ajax/'))) AS api, count(*) FILTER (NOT xhr AND resource_type = 'image') AS images,
      count(*) FILTER (NOT xhr AND resource_type = 'script') AS scripts, count(*) FILTER (contains(lower(url), 'captcha')) AS suspicious,
      count(*) FILTER (response_time > 5000) AS slow, count(*) FILTER (platform = 'weibo' AND contains(url, 'weibo.com/ajax')) AS weibo_api,
      count(*) FILTER (platform = 'weibo' AND contains(url, 'passport')) AS logins, count(*) FILTER (platform = 'weibo' AND status_code = 429) AS rate_limited,
      CAST(0 AS BIGINT) AS video_api, count(*) FILTER (platform = 'bilibili' AND contains(url, 'x/space')) AS user_api,
      count(*) FILTER (platform = 'bilibili' AND contains(url, 'hdslb')) AS cdn FROM flags GROUP BY 1),
      m AS (SELECT page_id, count(*) FILTER (type = 'Error') AS console_errors, count(*) FILTER (type = 'warning') AS console_warnings,
        count(*) FILTER (type = 'Error' AND text <> 'x') AS blocked FROM messages GROUP BY 1)
    SELECT r.*, console_errors, console_warnings, blocked, concat_ws('|', CASE WHEN failed > total * 0.3 THEN 'many_failures' END,
      CASE WHEN suspicious > 0 THEN 'suspicious_requests' END, CASE WHEN slow > 0 THEN 'slow_requests' END,
      CASE WHEN console_errors > 5 THEN 'console_errors' END, CASE WHEN blocked > 0 THEN 'blocked' END, CASE WHEN rate_limited > 0 THEN 'rate_limited' END) AS advice
    FROM r JOIN m ON m.page_id = r.page_id"""
)
def network_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent, told = requests(spark, sf_dir)
    found = stats.network_advice(stats.network_summary(sent, told, "page_id"))
    return found.withColumn("advice", F.array_join("advice", "|"))


@query(
    f"""WITH {REQUESTS_SQL} SELECT event_id, page_id, url, resource_type AS type, status_code AS status FROM requests WHERE contains(lower(url), 'captcha')"""
)
def suspicious_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.request_flags(requests(spark, sf_dir)[0]).filter("suspicious")
    return found.select("event_id", "page_id", "url", F.col("resource_type").alias("type"), F.col("status_code").alias("status"))


POSTS_SQL = f"""WITH {RESULTS_SQL}, p AS (SELECT page_id AS pos, page_id % 7 AS creator_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(page_id % 50 AS VARCHAR) END AS post_id,
    title, snippet AS content, title || '|' || snippet AS line FROM results),
  h AS (SELECT *, CASE WHEN strlen(line) < 10 THEN line ELSE concat_ws('_', CAST(strlen(line) AS VARCHAR), substring(line, 1, 5), right(line, 5)) END AS content_hash FROM p),
  old AS (SELECT * FROM h WHERE pos % 5 = 0), new AS (SELECT * FROM h WHERE pos % 5 <> 0)"""


@query(
    POSTS_SQL
    + """, a AS (SELECT * FROM new WHERE content_hash NOT IN (SELECT content_hash FROM old)
        AND NOT EXISTS (SELECT 1 FROM old WHERE old.post_id <> '' AND old.post_id = new.post_id AND old.creator_id = new.creator_id)),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY pos) = 1)
    SELECT pos, content_hash FROM b WHERE post_id = '' UNION ALL
    SELECT pos, content_hash FROM (SELECT * FROM b WHERE post_id <> '' QUALIFY row_number() OVER (PARTITION BY creator_id, post_id ORDER BY pos) = 1)"""
)
def incremental_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.functions.text import edge_hash

    pos = F.col("page_id")
    posts = results(spark, sf_dir).select(
        pos.alias("pos"),
        (pos % 7).alias("creator_id"),
        F.when(pos % 3 == 0, "").otherwise((pos % 50).cast("string")).alias("post_id"),
        "title",
        F.col("snippet").alias("content"),
    )
    old = posts.filter("pos % 5 = 0").withColumn("content_hash", edge_hash(F.concat_ws("|", "title", "content")))
    return dedup.incremental(posts.filter("pos % 5 <> 0"), old).select("pos", "content_hash")


@query(
    f"""WITH {RESULTS_SQL}, h AS (SELECT page_id AS pos, url, platform, sha256(title || '|' || snippet) AS content_hash, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'o' || page_id END AS origin_id FROM results),
      n AS (SELECT * FROM h WHERE pos % 3 <> 0 AND content_hash NOT IN (SELECT content_hash FROM h WHERE pos % 3 = 0)
        QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY pos) = 1)
    SELECT pos, coalesce(nullif(origin_id, ''), substring(content_hash, 1, 8) || '_17') AS origin_id, (SELECT count(*) FROM h WHERE pos % 3 <> 0) AS total,
      (SELECT count(*) FROM n) AS saved, (SELECT count(*) FROM h WHERE pos % 3 <> 0) - (SELECT count(*) FROM n) AS skipped FROM n"""
)
def saved_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("page_id")
    rows = results(spark, sf_dir).select(
        pos.alias("pos"), "url", "platform", F.sha2(F.concat("title", F.lit("|"), "snippet"), 256).alias("content_hash"), F.when(pos % 2 == 0, "").otherwise(F.concat(F.lit("o"), pos.cast("string"))).alias("origin_id")
    )
    rows = stored(rows, "hashed")  # batch and history read it, and so do the counts; texts stay behind
    batch, history = rows.filter("pos % 3 <> 0"), rows.filter("pos % 3 = 0")
    fresh = stored(dedup.saved(batch, history, 17), "saved")
    return fresh.select("pos", "origin_id").crossJoin(F.broadcast(dedup.save_counts(batch, fresh)))  # one row


#: What stands between tags, stripped, without anything between; the entities are those that the pages hold.
TEXT_SQL = r"""array_to_string(list_transform(string_split_regex({}, '<[^>]*>'),
  lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'),
    '&quot;', '"'), '&#39;', chr(39)), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '&amp', '&'), '^\s+|\s+$', '', 'g')), '')"""


@query(
    f"""SELECT page_id, regexp_replace({TEXT_SQL.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '^\\s+|\\s+$', '', 'g') AS title,
      {TEXT_SQL.format("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS content FROM pages"""
)
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_extract(table(spark, sf_dir, "pages")).select("page_id", "title", "content")
