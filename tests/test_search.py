"""Search results, their records, and request logs on literal cases."""

import datetime as dt

from pyspark.sql import functions as F

from siftline.operators import search, stats, store

AT = dt.datetime(2024, 2, 1)


def test_results_of_pages(spark):
    page = '<div class="result c-container"><h3><a href="http://x">T<em>1</em></a></h3><p class="c-abstract"> S </p></div>'
    rows = [(1, "u", page + page.replace("http://x", "")), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [tuple(r) for r in search.results_of(pages, "baidu").collect()] == [(1, 0, "T1", "http://x", "S")]
    assert search.results_of(pages, "bing").collect() == []


def test_linked_titles(spark):
    long = "a text that is long enough"
    rows = [
        (f'<h3><a href="u">A+B</a></h3><p>{long}</p><h2><a href=" v ">C</a></h2><p>short</p>', [("A+B", "u", long), ("C", "v", "")]),
        ('<a href="u">a link text</a><a href="v">登录页面登录</a>', [("a link text", "u", "相关搜索结果")]),
        ("", []),
    ]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(rows)], "k int, html string")
    got = [[tuple(x) for x in r["found"]] for r in df.select("k", search.linked_titles(F.col("html")).alias("found")).orderBy("k").collect()]
    assert got == [want for _, want in rows]


def test_records_of_results(spark):
    rows = [
        (1, "最新动态 @甲 #a#", "微博 #b #c #d", "https://a.b/1"),
        (2, "最新", None, "https://a.b/2"),
        (3, "最新视频 weibo", None, "https://a.b/3"),
        (4, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, title string, snippet string, url string")
    got = {r["id"]: r for r in search.posts_of(df, "weibo", "q").collect()}
    assert set(got) == {1, 3}
    assert (got[1]["author"], got[1]["content"], got[1]["tags"]) == ("@甲", "微博 #b #c #d", ["微博", "社交媒体", "q", "a", "b", "c"])
    assert (got[3]["author"], got[3]["content"], got[3]["published_at"]) == ("微博用户", "微博动态：最新视频 weibo", None)
    videos = {r["id"]: r["video_url"] for r in search.posts_of(df.withColumn("url", F.lit("https://a.b/Video")), "douyin", "最新").collect()}
    assert videos == {3: "https://a.b/Video"}


def test_network_analysis(spark):
    sent = [(1, "weibo", "xhr", "GET", "https://weibo.com/ajax/x", 429, 9000.0), (1, "weibo", "image", "post", "https://a.b/captcha", 200, None), (2, "news", None, None, None, None, None)]
    told = [(1, "Error", "Access denied")] + [(3, "error", "x")] * 6 + [(3, "warning", None)]
    requests = spark.createDataFrame(sent, "page_id int, platform string, resource_type string, method string, url string, status_code int, response_time double")
    messages = spark.createDataFrame(told, "page_id int, type string, text string")
    got = {r["page_id"]: r for r in stats.network_advice(stats.network_summary(requests, messages, "page_id")).collect()}
    assert got[1]["advice"] == ["many_failures", "suspicious_requests", "slow_requests", "blocked", "rate_limited"]
    assert (got[1]["total"], got[1]["xhr"], got[1]["api"], got[1]["images"], got[1]["weibo_api"]) == (2, 2, 1, 0, 1)
    assert got[2]["advice"] == [] and (got[3]["total"], got[3]["console_errors"], got[3]["console_warnings"]) == (0, 6, 1)
    assert got[3]["advice"] == ["console_errors"]


def test_crawls_taken_up_at_once(spark):
    rows = [(k, True, "idle", AT - dt.timedelta(minutes=k)) for k in range(1, 6)] + [(9, True, "idle", None), (7, False, "idle", None)]
    ddl = "id int, auto_crawl_enabled boolean, crawl_status string, next_crawl_at timestamp_ntz"
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    assert [r["id"] for r in store.taken_up(spark.createDataFrame(rows, ddl), as_of).collect()] == [9, 5, 4]
    busy = [*rows, (20, True, "crawling", None), (21, True, "crawling", None)]
    assert [r["id"] for r in store.taken_up(spark.createDataFrame(busy, ddl), as_of).collect()] == [9]
    full = [*busy, (22, True, "crawling", None), (23, True, "crawling", None)]
    assert store.taken_up(spark.createDataFrame(full, ddl), as_of).collect() == []
