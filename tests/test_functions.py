"""Column functions on literal cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline import catalog
from siftline.functions import classify, html, text, times, urls


def values(spark, inputs, make, ddl="s string"):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], f"i int, {ddl}")
    return [r["v"] for r in df.select("i", make.alias("v")).orderBy("i").collect()]


def test_edge_hash(spark):
    assert values(spark, ["abc", "0123456789", None], text.edge_hash(F.col("s"))) == ["abc", "10_01234_56789", None]


def test_queries_of_urls(spark):
    inputs = ["https://weibo.com/u/123", "科技", ""]
    assert values(spark, inputs, urls.query_of(F.col("s"), "weibo")) == ["weibo.com", "科技", "热门微博"]
    assert values(spark, ["https://a.b/x/news/y"], urls.news_query(F.col("s"))) == ["news"]
    assert values(spark, ["https://a.b/x/热点新闻", "https://a.b"], urls.chinese_query(F.col("s"), "d")) == ["热点新闻", "d"]


def test_relative_times(spark):
    as_of = F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")
    inputs = ["5分钟前", "3小时前", "2天前", "昨天", "2024-3-5", "3-5", "2024年3月5日", "foo", "2024-13-45", None]
    got = [str(x) for x in values(spark, inputs, times.relative_time(F.col("s"), as_of))]
    assert got == [
        "2024-06-15 11:55:00",
        "2024-06-15 09:00:00",
        "2024-06-13 12:00:00",
        "2024-06-14 12:00:00",
        "2024-03-05 00:00:00",
        "2024-03-05 00:00:00",
        "2024-03-05 00:00:00",
        "None",
        "None",
        "None",
    ]


def test_parse_time(spark):
    inputs = ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "2024/01/02 03:04:05", "01/02/2024", "2024-01-02", "never"]
    got = [str(x) for x in values(spark, inputs, times.parse_time(F.col("s")))]
    assert got == ["2024-01-02 03:04:05"] * 4 + ["2024-01-02 00:00:00"] * 2 + ["None"]


def test_cache_seconds(spark):
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    inputs = ["2024-01-01 00:00:10", "2024-01-01 01:00:00", None]
    assert values(spark, inputs, times.cache_seconds(F.col("s").cast("timestamp_ntz"), as_of)) == [60, 3600, 86400]


def test_platforms(spark):
    inputs = ["https://b23.tv/x", "https://xhs.cn/a", "https://example.com"]
    assert values(spark, inputs, urls.platform_of(F.col("s"))) == ["bilibili", "xiaohongshu", "news"]
    assert values(spark, inputs, urls.service_of(F.col("s"))) == ["bilibili", "general", "general"]


def test_valid_urls(spark):
    inputs = ["https://weibo.com/", "https://weibo.com/hot/search", "https://weibo.com/u/1/home", "ftp://a.b", "https://localhost/x", None]
    assert values(spark, inputs, urls.is_valid_url(F.col("s"))) == [False, False, True, False, False, False]


def test_url_types_and_static_pages(spark):
    assert values(spark, ["https://weibo.com/u/1", "https://www.bilibili.com/video/BV1", "https://x.com"], urls.url_type(F.col("s"))) == [
        "微博用户页面",
        "B站视频页面",
        "未知平台页面",
    ]
    assert values(spark, ["https://a.b/about", "https://a.b/p/1", "https://a.b/x.PNG"], urls.is_dynamic_url(F.col("s"))) == [False, True, False]
    assert values(spark, ["https://a.b/x.png?y", "https://img.a.b/1", "https://a.b/text"], urls.is_image_url(F.col("s"))) == [True, True, False]


def test_weibo_identifiers(spark):
    inputs = ["https://weibo.com/u/1195230310", "@name_1", "#周杰伦中文网JayCn", "  ", "https://weibo.com/n/%E5%91%A8", "https://weibo.com/hot", "https://x.com/a"]
    assert values(spark, inputs, urls.weibo_identifier(F.col("s"))) == ["1195230310", "name_1", "周杰伦中文网JayCn", None, "周", None, None]


def test_platform_pages(spark):
    inputs = [("123", "weibo"), ("ab", "weibo"), ("login", "weibo"), ("7", "bilibili"), ("@u", "douyin"), ("", "xiaohongshu"), ("x", "news"), ("https://a.b/about", "news")]
    got = values(spark, inputs, urls.platform_pages(F.col("s"), F.col("p")), "s string, p string")
    assert got[0] == ["https://weibo.com/u/123/home", "https://weibo.com/u/123?tabtype=feed", "https://weibo.com/123?is_all=1"]
    assert got[1][0] == "https://weibo.com/ab?tabtype=feed"
    # a reserved word is refused as a name; its plain pages are closed paths
    assert got[2] == ["https://weibo.com/n/login"]
    assert got[3][0] == "https://space.bilibili.com/7/dynamic"
    assert got[4] == ["https://www.douyin.com/@u", "https://www.douyin.com/user/u"]
    assert got[5][-1] == "https://www.xiaohongshu.com/explore"
    assert got[6] == ["https://www.zhihu.com/hot", "https://www.bilibili.com/v/popular/all"]
    assert got[7] == []


def test_titles_and_cleaning(spark):
    assert values(spark, ["标题 - 微博正文", "a_b"], text.clean_title(F.col("s"))) == ["标题", "a_b"]
    inputs = [("<p>好物 广告</p>", "news"), ("<p>转发 3 评论 4 赞 5 今天的内容很有意思，值得一看</p><script>x()</script>", "weibo")]
    got = values(spark, inputs, text.clean_content(F.col("s"), F.col("p")), "s string, p string")
    assert got == ["", "今天的内容很有意思，值得一看"]
    assert values(spark, ["三连一下支持 这是一个很长很长的视频简介内容"], text.clean_bilibili(F.col("s"))) == ["这是一个很长很长的视频简介内容"]
    assert values(spark, ["a<br/>b <i>c</i>"], text.break_lines(F.col("s"))) == ["a b <i>c</i>"]
    assert values(spark, [" a  b \n\n c "], text.text_lines(F.col("s"))) == ["a\nb\nc"]


def test_tags_authors_and_videos(spark):
    assert values(spark, ["#a #b# @c @c x"], text.hashtags(F.col("s"))) == [["a", "b", "@c"]]
    assert values(spark, ["#a# 种草 好物"], text.platform_tags(F.col("s"), "xiaohongshu")) == [["a", "种草", "好物"]]
    inputs = [("博主：张三 @x", "u"), ("没有", "https://weibo.com/u/42"), ("没有", "u")]
    assert values(spark, inputs, text.author(F.col("s"), F.col("u"), "weibo"), "s string, u string") == ["张三", "微博用户_42", "微博用户"]
    inputs = [("看 BV1xx", "u"), ("x", "https://www.bilibili.com/video/9"), ("x", "u")]
    got = values(spark, inputs, text.bilibili_video(F.col("s"), F.col("u")), "s string, u string")
    assert got == ["https://www.bilibili.com/video/BV1xx", "https://www.bilibili.com/video/9", None]
    assert values(spark, ["https://a.b/1.jpg x https://a.b/1.jpg https://a.b/2.PNG"], text.image_urls(F.col("s"))) == [["https://a.b/1.jpg", "https://a.b/2.PNG"]]


def test_page_errors(spark):
    clean = "干净的内容" * 40
    inputs = [("请登录", clean, "weibo"), ("标题", clean + "404", "news"), ("标题", "抱歉，该昵称目前不存在哦", "weibo"), ("标题", "短", "news"), ("标题", clean, "news")]
    error = classify.page_error(F.col("s"), F.col("c"), F.col("p"))
    got = values(spark, inputs, error, "s string, c string, p string")
    assert [(e["kind"], e["indicator"]) for e in got] == [
        ("需要登录", "请登录"),
        ("HTTP错误", "404"),
        ("微博用户不存在", "该昵称目前不存在"),
        ("内容过短", None),
        (None, None),
    ]


def test_crawl_errors_and_waits(spark):
    inputs = [("navigation timeout", "weibo"), ("connection timeout", "x"), ("timed out", "x"), ("403 forbidden", "douyin"), ("huh", "x")]
    got = values(spark, inputs, classify.crawl_error(F.col("s"), F.col("p")), "s string, p string")
    assert [e["type"] for e in got] == ["navigation", "network", "timeout", "bot_detection", "unknown"]
    assert got[0]["suggestion"] == "微博页面导航复杂，建议增加等待时间" and got[4]["suggestion"] == "建议检查网络连接和页面状态"
    inputs = [("stealth_retry", 0), ("stealth_retry", 9), ("none", 1)]
    assert values(spark, inputs, classify.retry_wait(F.col("s"), F.col("n")), "s string, n int") == [10, 30, 10]


def test_news_titles_are_tested_by_substring(spark):
    inputs = [("how to read this thing", "d"), ("the finest thing of all", "d"), ("the", "d")]
    assert values(spark, inputs, classify.news_related(F.col("s"), F.col("d"), "thing"), "s string, d string") == [False, True, False]


@pytest.mark.parametrize(("query", "score"), [("the", 7), ("none", 0), ("the end", 10)])
def test_relevance(spark, query, score):
    assert values(spark, [("The end", "the end of it")], classify.relevance(F.col("s"), F.col("c"), query), "s string, c string")== [score]


PAGE = """<!DOCTYPE html><html><head><title> A title </title><meta name="description" content="d"><style>p{}</style></head>
<body><nav><a href="/nav">nav</a></nav><article><h1>Head</h1><p>One <b>two</b><br>three<p>four <a href="/x?a=1&amp;b=2">link</a>
<img src="/logo.png"><img src="//c.d/p.jpg" alt="pic"></article><script>var t="</p>";</script></body>"""


def test_page_extract(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE), (2, None, None)], "page_id long, url string, html string")
    one, two = html.page_extract(pages).orderBy("page_id").collect()
    assert one["title"] == "A title"
    assert one["content"] == "HeadOnetwothreefourlink"
    assert [x["url"] for x in one["links"]] == ["http://a.b/nav", "http://a.b/x?a=1&b=2"]
    assert [(x["url"], x["alt"]) for x in one["images"]] == [("http://c.d/p.jpg", "pic")]
    assert one["metadata"]["meta_description"] == "d" and one["metadata"]["domain"] == "a.b"
    assert (two["title"], two["content"], two["links"]) == ("", "", [])


def test_page_contents_reads_cut_references_as_its_sql_does(spark, tmp_path):
    parts = ["say &quot", "&quotOne", "a &amp; b &amp", "&ampTwo", "&am", "&a", "x &", "&quo", "&quot;q&quot;", "&copy", "&copy;&middot;", "&#3", "&#38", "&lt", "&lt;b&gt;", "a=1&b=2", "&&amp;&"]
    rows = [(k, "http://a.b", f"<title>{x}</title><nav>n</nav><article><h1>{x}</h1><p><a href='?a=1&copy;=2'>{x}y</a></p></article>") for k, x in enumerate(parts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(catalog.ORACLES["page_contents"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["page_contents"](spark, str(tmp_path)).collect())) == sorted(want)
    assert [x[1] for x in sorted(want)][:4] == ["say &quot", "&quotOne", "a & b &", "&Two"]


def test_cut_references_leave_attributes_alone():
    page = "<a title='1>2&3' href='http://c.d/?a=1&b=2&amp;c=3'>x&y &quot</a><script>a&&b</script><img src='http://c.d/?a&b' alt='u>v&w'/>"
    _, content, text, links, images, _ = html.extracted(page, None)
    assert (content, text) == ("x&y &quot", "x&y &quot")
    assert links == [{"url": "http://c.d/?a=1&b=2&c=3", "text": "x&y &quot", "title": "1>2&3"}]
    assert images == [{"url": "http://c.d/?a&b", "alt": "u>v&w", "title": ""}]


@pytest.mark.parametrize(
    ("page", "css", "content"),
    [
        ("<article>a</article><main>m</main>", None, "m"),
        ("<div class=post>p</div><div class=news-content>n</div><div id=content>c</div>", None, "n"),
        ("<nav><main>no</main></nav><div class='post-body'>b<aside>x</aside></div>", None, "b"),
        ("<body><header>h</header>t<footer>f</footer></body>", None, "t"),
        ("<main>m</main><p class=x>1 </p><p class=x> 2</p>", ".x", "1 2"),
        ("<main>m</main>", ".missing", "m"),
        ("", None, ""),
    ],
)
def test_main_text(page, css, content):
    assert html.main_text(html.Tree(page).root, css) == content


def test_selectors_results_and_markdown():
    page = '<div class="r a"><h3><a href="http://x">T</a></h3><p class="s">S</p></div><div class="r"><h3>none</h3></div>'
    assert html.results(page, "div.r", "h3", "p.s") == [{"title": "T", "url": "http://x", "snippet": "S"}]
    assert html.fields(page, {"t": ".r h3", "tags": "h3", "no": "#x"}) == {"t": "T", "tags": ["T", "none"], "no": ""}
    assert html.markdown("<h2>H</h2><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li></ul>") == "## H\n\na **b** [c](u)\n\n- x"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html.extracted(deep, "")[1] == "x"
