"""Rules on literal cases, for texts that the tables don't hold: what each rule is specified to give for its inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import classify, text, times, urls
from siftline.operators import search

CASES: dict[str, tuple[str, Sequence[tuple], Callable[[], Column]]] = {}


def literal(name: str, columns: str, cases: Sequence[tuple], make: Callable[[], Column]) -> None:
    """Cases of inputs, each with the result as text; arrays are joined by |."""
    CASES[name] = columns, cases, make


def at() -> Column:
    return F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")


def c(name: str) -> Column:
    return F.col(name)


literal(
    "queries",
    "s string",
    [("https://weibo.com/u/123", "weibo.com"), ("科技", "科技"), ("", "热门微博")],
    lambda: urls.query_of(c("s"), "weibo"),
)
literal("news_queries", "s string", [("https://a.b/x/news/y", "news"), ("https://a.b/", None)], lambda: urls.news_query(c("s")))
literal(
    "chinese_queries",
    "s string",
    [("https://a.b/x/热点新闻", "热点新闻"), ("https://a.b", "default"), ("https://a.b/12345/新闻", "default")],
    lambda: urls.chinese_query(c("s"), "default"),
)
literal(
    "service_hosts",
    "s string",
    [("https://b23.tv/x", "bilibili"), ("https://xhs.cn/a", "general"), ("https://weibo.cn/1", "weibo"), ("https://xhslink.com/q", "xiaohongshu")],
    lambda: urls.service_of(c("s")),
)
literal(
    "url_types",
    "s string",
    [
        ("https://weibo.com/u/1", "微博用户页面"),
        ("https://weibo.com/a?is_all=1", "微博动态页面"),
        ("https://weibo.com/a", "微博首页或其他页面"),
        ("https://www.bilibili.com/video/BV1", "B站视频页面"),
        ("https://www.xiaohongshu.com/explore/1", "小红书动态页面"),
        ("https://www.douyin.com/user/1", "抖音动态页面"),
        ("https://x.com", "未知平台页面"),
    ],
    lambda: urls.url_type(c("s")),
)
literal(
    "identifiers",
    "s string",
    [
        ("https://weibo.com/u/1195230310", "1195230310"),
        ("@name_1", "name_1"),
        ("#周杰伦中文网JayCn", "周杰伦中文网JayCn"),
        ("  ", None),
        ("https://weibo.com/n/%E5%91%A8", "周"),
        ("https://weibo.com/hot", None),
        ("https://x.com/a", None),
    ],
    lambda: urls.weibo_identifier(c("s")),
)
literal(
    "user_pages",
    "s string, p string",
    [
        ("123", "weibo", "https://weibo.com/u/123/home|https://weibo.com/u/123?tabtype=feed|https://weibo.com/123?is_all=1"),
        ("login", "weibo", "https://weibo.com/n/login"),
        ("7", "bilibili", "https://space.bilibili.com/7/dynamic|https://space.bilibili.com/7/video|https://space.bilibili.com/7"),
        ("@u", "douyin", "https://www.douyin.com/@u|https://www.douyin.com/user/u"),
        ("x", "news", "https://www.zhihu.com/hot|https://www.bilibili.com/v/popular/all"),
        ("https://a.b/about", "news", ""),
    ],
    lambda: urls.platform_pages(c("s"), c("p")),
)
literal(
    "links",
    "s string, base string",
    [("//c.d/x", "https://a.b/p", "https://c.d/x"), ("/x?y", "https://a.b/p/q", "https://a.b/x?y"), ("http://e.f", "https://a.b", "http://e.f")],
    lambda: urls.absolute(c("s"), c("base")),
)
literal(
    "search_addresses",
    "s string",
    [("科技", "https://www.baidu.com/s?wd=%E7%A7%91%E6%8A%80+site%3Aweibo.com|https://www.sogou.com/web?query=%E7%A7%91%E6%8A%80+site%3Aweibo.com|https://www.bing.com/search?q=%E7%A7%91%E6%8A%80+site%3Aweibo.com")],
    lambda: urls.search_addresses(c("s"), "weibo"),
)
literal("titles", "s string", [("标题 - 微博正文", "标题"), ("a_b", "a_b"), ("x | 抖音", "x")], lambda: text.clean_title(c("s")))
literal(
    "clean_content",
    "s string, p string",
    [
        ("<p>好物 广告</p>", "news", ""),
        ("<p>转发 3 评论 4 赞 5 今天的内容很有意思，值得一看</p><script>x()</script>", "weibo", "今天的内容很有意思，值得一看"),
        ("Copyright 2024 一句足够长的话留在这里吧", "news", "一句足够长的话留在这里吧"),
    ],
    lambda: text.clean_content(c("s"), c("p")),
)
literal(
    "clean_spans",
    "s string",
    [("三连一下支持 这是一个很长很长的视频简介内容", "这是一个很长很长的视频简介内容")],
    lambda: text.clean_bilibili(c("s")),
)
literal("line_breaks", "s string", [("a<br/>b <i>c</i>", "a b <i>c</i>"), ("x<BR>y", "x<BR>y")], lambda: text.break_lines(c("s")))
literal("text_lines", "s string", [(" a  b \n\n c ", "a\nb\nc"), ("", "")], lambda: text.text_lines(c("s")))
literal("hashtags", "s string", [("#a #b# @c @c x", "a|b|@c"), ("none", "")], lambda: text.hashtags(c("s")))
literal("topics", "s string", [("#a b# x # #", "a b"), ("#a", "")], lambda: text.topics(c("s")))
literal(
    "tags_xiaohongshu", "s string", [("#a# 种草 好物", "a|种草|好物"), ("x", "")], lambda: text.platform_tags(c("s"), "xiaohongshu")
)
literal("tags_bilibili", "s string", [("#a# x", "bilibili|B站|哔哩哔哩|a"), ("今天聊聊 #黑神话 的游戏 直播 #科技#", "bilibili|B站|哔哩哔哩|黑神话|科技|游戏|直播"), ("#a b# 投稿", "bilibili|B站|哔哩哔哩|a|投稿")], lambda: text.platform_tags(c("s"), "bilibili"))
literal("tags_weibo", "s string", [("#a# @b c", "a|@b")], lambda: text.platform_tags(c("s"), "weibo"))
literal(
    "leading_tags",
    "s string, q string",
    [("#x #微博", "q", "微博|社交媒体|q|x")],
    lambda: text.leading_tags(c("s"), c("q"), "weibo"),
)
literal(
    "authors",
    "s string, u string",
    [("博主：张三 @x", "u", "张三"), ("没有", "https://weibo.com/u/42", "微博用户_42"), ("没有", "u", "微博用户")],
    lambda: text.author(c("s"), c("u"), "weibo"),
)
literal(
    "service_authors",
    "t string, s string, p string",
    [
        ("见 @甲 x", "@乙", "weibo", "@甲"),
        ("UP主小明：视频", "d", "bilibili", "UP主小明"),
        ("UP主小明：视频", "d", "douyin", "抖音创作者"),
        ("t", "d", "other", "创作者"),
    ],
    lambda: search.service_author(c("t"), c("s"), c("p")),
)
literal(
    "title_authors",
    "t string",
    [("看 @甲 的视频", "@甲"), ("UP主小红 新作", "UP主小红"), ("没有", "B站UP主")],
    lambda: search.title_author(c("t"), "bilibili"),
)
literal(
    "videos",
    "s string, u string",
    [
        ("看 BV1xx", "u", "https://www.bilibili.com/video/BV1xx"),
        ("x", "https://www.bilibili.com/video/9", "https://www.bilibili.com/video/9"),
        ("x", "u", None),
    ],
    lambda: text.bilibili_video(c("s"), c("u")),
)
literal(
    "video_files",
    "s string",
    [("a https://a.b/x.MP4 b", "https://a.b/x.MP4"), ("https://v.douyin.com/q/ x", "https://v.douyin.com/q/"), ("none", None)],
    lambda: text.video_url(c("s")),
)
literal(
    "result_videos",
    "u string, p string",
    [("https://www.bilibili.com/x", "bilibili", "https://www.bilibili.com/x"), ("https://a.b/Video/1", "douyin", "https://a.b/Video/1"), ("https://a.b/video", "weibo", "")],
    lambda: text.result_video(c("u"), c("p")),
)
literal(
    "images",
    "s string",
    [("https://a.b/1.jpg x https://a.b/1.jpg https://a.b/2.PNG", "https://a.b/1.jpg|https://a.b/2.PNG")],
    lambda: text.image_urls(c("s")),
)
literal(
    "best_titles",
    "t string, h string",
    [("a long title", "<title>x</title>", "a long title"), ("ab", "<title>Page title - 微博</title>", "Page title"), ("", "", "未知标题")],
    lambda: text.best_title(c("t"), c("h")),
)
literal(
    "url_titles",
    "u string",
    [
        ("https://weibo.com/u/1", "微博用户动态"),
        ("https://weibo.com/status/1", "微博动态"),
        ("https://weibo.com/a/%E6%96%B0/12", "weibo内容 - 新"),
        ("https://weibo.com/", "weibo内容"),
    ],
    lambda: search.url_title(c("u"), "weibo"),
)
literal(
    "best_contents",
    "a string, m string, h string",
    [("x" * 120, "m", "h", "x" * 120), ("x" * 60, "m", "h", "h"), ("a", "y" * 120, "h", "y" * 120), ("a", "m", "<p>" + "z" * 110 + "</p>", "z" * 110), ("a", "m", "<p>short</p>", "<p>short</p>")],
    lambda: text.best_content(c("a"), c("m"), c("h")),
)
literal(
    "times",
    "s string",
    [
        ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024/01/02 03:04:05", "2024-01-02 03:04:05"),
        ("01/02/2024 03:04:05", "2024-01-02 03:04:05"),
        ("01/02/2024", "2024-01-02 00:00:00"),
        ("2024-01-02", "2024-01-02 00:00:00"),
        ("never", None),
    ],
    lambda: times.parse_time(c("s")),
)
literal(
    "zoned_times",
    "s string",
    [("2024-01-02T03:04:05+08:00", "2024-01-01 19:04:05"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", None)],
    lambda: times.zoned_time(c("s")),
)
literal(
    "relative_times",
    "s string",
    [
        ("5分钟前", "2024-06-15 11:55:00"),
        ("3小时前", "2024-06-15 09:00:00"),
        ("2天前", "2024-06-13 12:00:00"),
        ("昨天", "2024-06-14 12:00:00"),
        ("今天 10:00", "2024-06-15 12:00:00"),
        ("2024-3-5", "2024-03-05 00:00:00"),
        ("3-5", "2024-03-05 00:00:00"),
        ("2024年3月5日", "2024-03-05 00:00:00"),
        ("foo", None),
        ("2024-13-45", None),
    ],
    lambda: times.relative_time(c("s"), at()),
)
literal(
    "cache_seconds",
    "s string",
    [("2024-06-15 12:00:10", 60), ("2024-06-15 13:00:00", 3600), (None, 86400)],
    lambda: times.cache_seconds(c("s").cast("timestamp_ntz"), at()),
)
literal(
    "interval_labels",
    "ms long, cron string, once boolean",
    [(3_600_000, None, False, "每1小时"), (1_800_000, None, False, "每30分钟"), (0, "0 0 * * *", False, "0 0 * * *"), (0, None, True, "一次性")],
    lambda: text.interval_label(c("ms"), c("cron"), c("once")),
)
CLEAN = "干净的内容" * 40
literal(
    "page_errors",
    "t string, s string, p string",
    [
        ("请登录", CLEAN, "weibo", "需要登录/请登录"),
        ("标题", CLEAN + "404", "news", "HTTP错误/404"),
        ("标题", "抱歉，该昵称目前不存在哦", "weibo", "微博用户不存在/该昵称目前不存在"),
        ("标题", "短", "news", "内容过短"),
        ("标题", CLEAN, "news", ""),
    ],
    lambda: F.concat_ws("/", classify.page_error(c("t"), c("s"), c("p"))["kind"], classify.page_error(c("t"), c("s"), c("p"))["indicator"]),
)
literal(
    "crawl_errors",
    "s string, p string",
    [
        ("navigation timeout", "weibo", "navigation/微博页面导航复杂，建议增加等待时间"),
        ("connection timeout", "x", "network/建议检查网络连接和页面状态"),
        ("timed out", "x", "timeout/建议检查网络连接和页面状态"),
        ("huh", "x", "unknown/建议检查网络连接和页面状态"),
    ],
    lambda: F.concat_ws("/", classify.crawl_error(c("s"), c("p"))["type"], classify.crawl_error(c("s"), c("p"))["suggestion"]),
)
literal(
    "retry_waits",
    "s string, n int",
    [("stealth_retry", 0, 10), ("stealth_retry", 9, 30), ("none", 1, 10), ("parsing_retry", 2, 8)],
    lambda: classify.retry_wait(c("s"), c("n")),
)
literal(
    "retry_limits",
    "s string, n int, p string",
    [
        ("network", 1, "x", "180000 15.0"),
        ("timeout", 0, "weibo", "270000 24.0"),
        ("parsing", 3, "news", "60000 3.0"),
        ("navigation", 0, "x", "90000 5.0"),
        ("unknown", 7, "douyin", "360000 36.0"),
    ],
    lambda: F.concat_ws(" ", *(classify.retry_limits(c("s"), c("n"), c("p"))[x].cast("string") for x in ("timeout_ms", "delay_s"))),
)
literal(
    "fetch_services",
    "script boolean, css string, host string, failed boolean",
    [
        (True, None, "a.b", False, "browser"),
        (False, "", "a.b", False, "local"),
        (False, None, "spa.com", False, "browser"),
        (False, ".x", "a.b", True, "local from browser"),
        (False, None, "a.b", True, "browser from local"),
    ],
    lambda: fetched(classify.fetch_service(c("script"), c("css"), c("host"), F.lit(""), ["spa.com"])),
)


def fetched(first: Column) -> Column:
    found = classify.fallback_service(first, c("failed"))
    return F.concat_ws(" from ", found["service"], found["fallback_from"])


literal(
    "login_states",
    "h string, u string",
    [
        ("<img class=user-avatar>", "https://a.b/login", "logged_in"),
        ("请登录", "https://a.b", "logged_out"),
        ("x", "https://a.b/Login?x", "logged_out"),
        ("x", "https://a.b", "unknown"),
    ],
    lambda: classify.login_state(c("h"), c("u"), ["user-avatar"], ["请登录"], ["/login"]),
)
literal(
    "news_related",
    "t string, s string",
    [("how to read this thing", "d", "false"), ("the finest thing of all", "d", "true"), ("thing", "d", "false")],
    lambda: classify.news_related(c("t"), c("s"), "thing"),
)
for platform, cases in {
    "weibo": [("最新动态", "d", "https://a.b/1", "true"), ("最新 home", "d", "https://a.b/1", "false"), ("最新", "d", "https://a.b/", "false")],
    "douyin": [("最新", "x", "https://a.b/1", "false"), ("最新视频", "x", "https://a.b/1", "true"), ("最新视频", "x", "https://a.b/download", "false")],
    "xiaohongshu": [("好物", "x", "https://a.b/", "true"), ("好物", "登录", "https://a.b/1", "false"), ("x", "y", "https://a.b/1", "false")],
    "bilibili": [("UP主", "x", "https://a.b/1", "true"), ("游", "戏", "https://a.b/1", "true"), ("游戏", "x", "https://a.b/main", "false")],
}.items():
    literal(f"results_{platform}", "t string, s string, u string", cases, lambda platform=platform: classify.dynamic_result(c("t"), c("s"), c("u"), platform))


@pytest.mark.parametrize("name", CASES)
def test_rule_on_literal_cases(spark, name):
    columns, cases, make = CASES[name]
    given = spark.createDataFrame([(k, *x) for k, (*x, _) in enumerate(cases)], f"k long, {columns}").select("k", make().alias("found"))
    kind = dict(given.dtypes)["found"]
    found = given.withColumn("found", F.array_join("found", "|") if kind.startswith("array") else F.col("found").cast("string"))
    assert [r["found"] for r in found.orderBy("k").collect()] == [None if x is None else str(x) for *_, x in cases]
