"""Sessions, cookies, configuration and requests on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import sessions as S

AT = dt.datetime(2024, 1, 10)
DDL = "session_id string, is_active boolean, expires_at timestamp_ntz"


def as_of():
    return F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")


def test_logins_fold_instances(spark):
    sessions = spark.createDataFrame([("a", True, None), ("b", True, None), ("c", False, None)], DDL)
    instances = spark.createDataFrame([("a", 1, False, None), ("a", 3, True, "z"), ("a", 2, False, "y"), ("b", 4, False, None)], "session_id string, instance_id int, is_logged_in boolean, login_user string")
    got = {r["session_id"]: (r["any_logged_in"], r["login_user"], r["n_instances"]) for r in S.logins(sessions, instances).collect()}
    assert got == {"a": (True, "y", 3), "b": (False, None, 1), "c": (False, None, 0)}


def test_expiry_splits_and_extends(spark):
    rows = [("a", True, AT), ("b", True, AT - dt.timedelta(1)), ("c", False, None), ("d", None, None)]
    df = spark.createDataFrame(rows, DDL)
    valid, expired = S.split_expired(df, as_of())
    assert [r["session_id"] for r in valid.collect()] == ["a"]
    assert sorted(r["session_id"] for r in expired.collect()) == ["b", "c", "d"]
    more = {r["session_id"]: r["expires_at"] for r in S.extended(df, df.filter("session_id = 'b'"), as_of(), 2).collect()}
    assert more["b"] == AT + dt.timedelta(hours=2) and more["a"] == AT
    gone = S.closed(df.withColumn("closed_at", F.lit(None).cast("timestamp_ntz")), F.col("session_id") == "a", as_of()).collect()
    assert {r["session_id"]: (r["is_active"], r["closed_at"]) for r in gone}["a"] == (False, AT)


def test_cookies_are_sealed_and_opened(spark):
    ddl = "browser_instance_id string, platform string, domain string, cookies array<struct<name:string,value:string>>, expires_at timestamp_ntz"
    rows = [("i", "weibo", "a", [("k", "v"), ("l", "w")], None), ("j", "weibo", "b", [("m", "x")], AT - dt.timedelta(1))]
    sealed = S.sealed(spark.createDataFrame(rows, ddl), "0123456789abcdef")
    assert "cookies" not in sealed.columns
    got = S.opened(sealed, "0123456789abcdef", as_of(), platform="weibo")
    assert sorted((r["name"], r["value"]) for r in got.collect()) == [("k", "v"), ("l", "w")]
    assert S.opened(sealed, "another-key-16by", as_of()).count() == 0


def test_configurations_merge(spark):
    ddl = "platform string, config map<string,string>"
    wanted = spark.createDataFrame([("a", {"x": "own"}), ("b", None), ("c", None)], ddl)
    browser = spark.createDataFrame([("a", {"x": "1", "y": "2"})], ddl)
    local = spark.createDataFrame([("a", {"z": "9"}), ("b", {"z": "3"})], ddl)
    got = {r["platform"]: r["config"] for r in S.merged_config(wanted, browser, local).collect()}
    assert got == {"a": {"y": "2", "x": "own"}, "b": {"z": "3"}, "c": {}}
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}, None), (2, {}, None)], "id int, fields map<string,string>, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, {"b": "3"})], "id int, fields map<string,string>")
    got = {r["id"]: (r["fields"], r["updated_at"]) for r in S.changed_fields(old, new, "id", as_of()).collect()}
    assert got == {1: ({"a": "1", "b": "3"}, AT), 2: ({}, None)}


def test_requests_nesting_and_health(spark):
    creators = spark.createDataFrame([("u", "", "weibo"), ("v", "http://p", "weibo")], "username string, profile_url string, platform string")
    assert sorted(r["creator_url"] for r in S.crawl_requests(creators).collect()) == ["http://p", "u"]
    items = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "category string, name string")
    assert {r["category"]: r["items"] for r in S.nested(items, "category", "name").collect()} == {"a": ["x", "y"], "b": ["z"]}
    parts = spark.createDataFrame([("db", True), ("cache", None)], "name string, ok boolean")
    assert tuple(S.health(parts).first()) == (False, ["cache"])
    both = S.system_stats({"one": creators.agg(F.count("*").alias("n")), "two": items.agg(F.count("*").alias("n"))})
    assert both.first().asDict() == {"one_n": 2, "two_n": 3}
    assert S.platforms(spark).count() == 6
    many = spark.range(25)
    assert sorted(r["id"] for r in S.evicted_everywhere(many, ["id"]).collect()) == [0, 1, 2, 3, 4, 5]


def test_request_errors(spark):
    df = spark.createDataFrame([("YouTube", "u"), ("", "u"), ("myspace", "u")], "p string, u string")
    assert [r[0] for r in df.select(S.crawl_request_error(F.col("p"), F.col("u"))).collect()] == [None, "missing_parameters", "unsupported_platform"]
    rows = [(["a"], "vlog", 60), ([], "vlog", 60), (["a"], "x", 60), (["a"], "vlog", 10), (None, None, None)]
    df = spark.createDataFrame(rows, "p array<string>, s string, d int")
    got = [r[0] for r in df.select(S.video_request_error(F.col("p"), F.col("s"), F.col("d"))).collect()]
    assert got == [None, "posts_required", "style_unknown", "duration_out_of_range", "posts_required"]


def test_picks_of_content_title_and_video(spark):
    page = "<html><title>A page title</title><body>" + "word " * 30 + "</body></html>"
    df = spark.createDataFrame([("", "m" * 60, page, "tiny"), ("c" * 120, "", page, "A given title"), ("", "", "<p>short</p>", "")], "c string, m string, h string, t string")
    got = df.select(text.best_content(F.col("c"), F.col("m"), F.col("h")), text.best_title(F.col("t"), F.col("h"))).collect()
    assert [r[1] for r in got] == ["A page title", "A given title", "未知标题"]
    assert got[0][0] == page and got[1][0] == "c" * 120 and got[2][0] == "<p>short</p>"
    df = spark.createDataFrame([("see http://a.b/x.MP4 now", "http://a.b/video", "douyin"), ("https://v.douyin.com/q", "http://a.b", "bilibili"), ("none", "http://x", "news")], "s string, u string, p string")
    got = [tuple(r) for r in df.select(text.video_url(F.col("s")), text.result_video(F.col("u"), F.col("p"))).collect()]
    assert got == [("http://a.b/x.MP4", "http://a.b/video"), ("https://v.douyin.com/q", ""), (None, "")]
    assert df.select(text.leading_tags(F.lit("#a b #微博"), F.lit("q"), "weibo")).first()[0] == ["微博", "社交媒体", "q", "a"]
