"""Queries over what a service keeps: cards, sweeps, sessions, cookies, configurations, stored files, documents of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import html, text
from siftline.operators import records, sessions, stats, store, windows
from siftline.plans.registry import AS_OF, CONTENTS_SQL, as_of, contents, query
from siftline.plans.tables import PLATFORM_OF, SESSIONS_SQL, TASKS_SQL, platform_by, tasks
from siftline.plans.tables import sessions as session_rows
from siftline.sources.shared import own_path
from siftline.sources.tables import backed_up, by_content_hash, by_hash_in_path, listing, response_posts, restored, seeded, with_prefix, with_task_defaults
from siftline.sources.tables import table as read
from siftline.streaming import requests

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


@query(
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 10 ELSE o_orderkey % 4 * 5 END AS BIGINT) AS "limit", 'pending' AS status FROM orders"""
)
def task_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4 * 5).alias("limit"))
    return with_task_defaults(given).select("o_orderkey", F.col("limit").cast("long").alias("limit"), "status")


@query(
    """SELECT count(*) AS tasks, count(*) FILTER (o_orderstatus = 'O') AS running, CAST(sum(o_orderkey % 7) AS BIGINT) AS succeeded,
      CAST(coalesce(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 END), 0) AS BIGINT) AS failed, round(avg(CAST(o_orderkey % 100 AS DOUBLE)), 4) AS mean_duration FROM orders"""
)
def scheduler_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("task_id")
    given = tasks(spark, sf_dir).select(
        "status",
        (key % 7).alias("successful_runs"),
        F.when(key % 3 == 0, 1).alias("failed_runs"),
        (key % 100).cast("double").alias("average_duration"),
    )
    return stats.scheduler_cards(given)


@query(
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS active, CAST(sum(o_orderkey % 9) AS BIGINT) AS execution_count,
      CAST(coalesce(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END), 0) AS BIGINT) AS time_saved FROM orders"""
)
def workflow_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    given = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("paused").alias("status"),
        (key % 9).alias("execution_count"),
        F.when(key % 2 == 0, key % 5).alias("time_saved"),
    )
    return stats.workflow_cards(given)


@query("SELECT count(DISTINCT p_type) AS categories, count(*) FILTER (p_size > 25) AS connected FROM part")
def integration_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") > 25, "connected").otherwise("available")
    return stats.integration_cards(read(spark, sf_dir, "part").select(F.col("p_type").alias("category"), status.alias("status")))


@query("SELECT DISTINCT p_type AS category FROM part")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_type").alias("category")).distinct()


@query(
    """SELECT count(*) FILTER (event_type IN ('error', 'view')) AS active, count(*) FILTER (event_type = 'error') AS critical,
      count(*) FILTER (event_id % 3 <> 0) AS unread FROM events"""
)
def alert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    given = read(spark, sf_dir, "events").select(
        F.when(kind.isin("error", "view"), "active").otherwise("resolved").alias("status"),
        F.when(kind == "error", "critical").otherwise("info").alias("severity"),
        F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False).alias("read"),
    )
    return stats.alert_cards(given)


@query(
    f"""SELECT {PLATFORM_OF.format('user_id')} AS platform, count(*) AS posts, CAST(sum(event_id % 100) AS BIGINT) AS views,
      round(CAST(sum(event_id % 7) AS DOUBLE) * 100 / nullif(sum(event_id % 100), 0), 4) AS engagement_rate,
      round(count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*), 4) AS success_rate FROM events GROUP BY 1"""
)
def platform_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "events").select(
        platform_by("user_id").alias("platform"), (F.col("event_id") % 100).alias("views"), (F.col("event_id") % 7).alias("engaged"), (F.col("event_type") != "error").alias("ok")
    )
    return stats.platform_overview(given)


@query(f"WITH {SESSIONS_SQL} SELECT session_id FROM sessions WHERE NOT (coalesce(expires_at < {AS_OF_SQL}, false) OR NOT is_active)")
def sweep_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(session_rows(spark, sf_dir), store.expired(as_of())).select("session_id")


@query(f"SELECT event_id FROM events WHERE NOT ts < {AS_OF_SQL} - INTERVAL 10 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(read(spark, sf_dir, "events"), store.older_than(F.col("ts"), as_of(), 10)).select("event_id")


@query(
    f"""WITH {SESSIONS_SQL}, gone AS (SELECT DISTINCT session_id FROM sessions WHERE coalesce(expires_at < {AS_OF_SQL}, false))
    SELECT event_id FROM events WHERE CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) NOT IN (SELECT session_id FROM gone)"""
)
def without_expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = session_rows(spark, sf_dir).filter(F.col("expires_at") < as_of()).select("session_id")
    name = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string"))
    events = read(spark, sf_dir, "events").select("event_id", name.alias("session_id"))
    return sessions.without_sessions(events, gone).select("event_id")


@query(
    f"""WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN user_id % 3 = 0 THEN {AS_OF_SQL} + INTERVAL 12 HOUR ELSE expires_at END AS expires_at FROM sessions"""
)
def extended_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_rows(spark, sf_dir)
    return sessions.extended(rows, rows.filter("user_id % 3 = 0"), as_of(), 12).select("session_id", "expires_at")


@query(
    f"""WITH {SESSIONS_SQL}, n AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_id, event_type <> 'error' AS is_logged_in,
        CASE WHEN event_id % 2 = 0 THEN 'u' || event_id END AS login_user FROM events WHERE event_type <> 'view'),
      l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) = 1)
    SELECT s.session_id, coalesce(l.is_logged_in, s.is_logged_in) AS is_logged_in, coalesce(l.login_user, 'old') AS login_user,
      CASE WHEN l.session_id IS NULL THEN s.last_activity ELSE {AS_OF_SQL} END AS last_activity FROM sessions s LEFT JOIN l ON l.session_id = s.session_id"""
)
def login_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = read(spark, sf_dir, "events").filter("event_type <> 'view'").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("is_logged_in"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("login_user"),
    )
    old = session_rows(spark, sf_dir).select("session_id", "is_logged_in", F.lit("old").alias("login_user"), "last_activity")
    return sessions.logged_in(old, news, as_of())


@query(
    f"""WITH {SESSIONS_SQL}, i AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_id, event_type = 'purchase' AS ok,
        CASE WHEN event_type = 'purchase' THEN 'u' || event_id END AS login_user FROM events),
      f AS (SELECT session_id, bool_or(ok) AS any_logged_in, arg_min(login_user, event_id) FILTER (login_user IS NOT NULL) AS login_user, count(*) AS n FROM i GROUP BY 1)
    SELECT s.session_id, any_logged_in, login_user, n AS n_instances FROM sessions s JOIN f ON f.session_id = s.session_id"""
)
def session_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    instances = read(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        F.col("event_id").alias("instance_id"),
        bought.alias("is_logged_in"),
        F.when(bought, F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("login_user"),
    )
    return sessions.logins(session_rows(spark, sf_dir).select("session_id"), instances)


@query(
    f"""WITH {SESSIONS_SQL} SELECT session_id, is_active AND NOT coalesce(expires_at < {AS_OF_SQL}, false) AS is_active,
      CASE WHEN is_active AND coalesce(expires_at < {AS_OF_SQL}, false) THEN {AS_OF_SQL} END AS closed_at FROM sessions"""
)
def closed_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_rows(spark, sf_dir).withColumn("closed_at", F.lit(None).cast("timestamp_ntz"))
    return sessions.closed(rows, F.col("expires_at") < as_of(), as_of()).select("session_id", "is_active", "closed_at")


@query(
    f"""WITH {SESSIONS_SQL} SELECT session_id, 'valid' AS state FROM sessions WHERE is_active AND (expires_at IS NULL OR expires_at >= {AS_OF_SQL})
    UNION ALL SELECT session_id, 'expired' FROM sessions WHERE NOT (is_active AND (expires_at IS NULL OR expires_at >= {AS_OF_SQL}))"""
)
def split_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, gone = sessions.split_expired(session_rows(spark, sf_dir), as_of())
    return valid.select("session_id", F.lit("valid").alias("state")).union(gone.select("session_id", F.lit("expired")))


@query(
    f"""WITH {SESSIONS_SQL} SELECT session_id, platform FROM sessions WHERE (last_activity, session_id) <
      (SELECT min((last_activity, session_id)) FROM (SELECT last_activity, session_id FROM sessions ORDER BY last_activity DESC, session_id DESC LIMIT 19))"""
)
def evict_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.evicted_everywhere(session_rows(spark, sf_dir), ["last_activity", "session_id"])
    return found.select("session_id", "platform")


COOKIE_KEY = "0123456789abcdef"


@query(
    f"""SELECT user_id AS browser_instance_id, {PLATFORM_OF.format('user_id')} AS platform, 'd' || user_id % 3 AS domain, 'k' || event_id AS name, event_type AS value
    FROM events WHERE user_id % 4 <> 0 AND {PLATFORM_OF.format('user_id')} = 'weibo'"""
)
def opened_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cookie = F.struct(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("name"), F.col("event_type").alias("value"))
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("browser_instance_id"),
        platform_by("user_id").alias("platform"),
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("domain"),
        F.array(cookie).alias("cookies"),
        F.when(F.col("user_id") % 4 == 0, as_of() - F.expr("interval 1 day")).when(F.col("user_id") % 4 == 1, as_of()).alias("expires_at"),
    )
    return sessions.opened(sessions.sealed(rows, COOKIE_KEY), COOKIE_KEY, as_of(), platform="weibo")


@query(
    f"""SELECT user_id, count(*) AS n, min(coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, {AS_OF_SQL} + INTERVAL 30 DAY)) AS first_end FROM events GROUP BY 1"""
)
def restored_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("timestamp_ntz")
    rows = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("expires_at"), nothing.alias("created_at"), nothing.alias("updated_at"))
    found = sessions.restored_cookies(rows, as_of()).filter((F.col("created_at") == as_of()) & (F.col("updated_at") == as_of()))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.min("expires_at").alias("first_end"))


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'own' WHEN n_nationkey % 2 = 0 THEN 'browser' ELSE 'local' END AS wait FROM nation"""
)
def merged_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    keys = read(spark, sf_dir, "nation").select(key.cast("string").alias("platform"), "n_nationkey")
    wanted = keys.withColumn("config", F.when(key % 3 == 0, F.create_map(F.lit("wait"), F.lit("own"))))

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("platform", F.create_map(F.lit("wait"), F.lit(name), F.lit("other"), F.lit("x")).alias("config"))

    found = sessions.merged_config(wanted, side("browser", keys.filter("n_nationkey % 2 = 0")), side("local", keys))
    return found.select("n_nationkey", F.col("config")["wait"].alias("wait"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0")
def enabled_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, True).alias("enabled"), F.when(F.col("n_nationkey") % 2 == 0, "weibo").otherwise("news").alias("platform")
    )
    return store.enabled(rows, "weibo").select("n_nationkey")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://a.b/' || c_custkey ELSE c_name END AS creator_url, CAST(20 AS BIGINT) AS "limit" FROM customer"""
)
def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://a.b/"), F.col("c_custkey").cast("string"))).otherwise("")
    creators = read(spark, sf_dir, "customer").select(url.alias("profile_url"), F.col("c_name").alias("username"), F.col("c_custkey").cast("string").alias("platform"))
    found = sessions.crawl_requests(creators)
    return found.select(F.col("platform").cast("long").alias("c_custkey"), "creator_url", F.col("limit").cast("long").alias("limit"))


@query("SELECT p_type AS category, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS items FROM part GROUP BY 1")
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.nested(read(spark, sf_dir, "part").withColumnRenamed("p_type", "category"), "category", "p_brand")
    return found.select("category", F.array_join("items", "|").alias("items"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing_parameters' WHEN event_id % 4 = 1 THEN 'unsupported_platform' END AS crawl_error,
      CASE WHEN event_id % 5 = 0 THEN 'posts_required' WHEN event_id % 5 = 1 THEN 'style_unknown' WHEN event_id % 5 = 2 THEN 'duration_out_of_range' END AS video_error FROM events"""
)
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    platform = F.when(k % 4 == 0, "").when(k % 4 == 1, "myspace").otherwise("YouTube")
    posts = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p")))
    style, seconds = F.when(k % 5 == 1, "opera").otherwise("vlog"), F.when(k % 5 == 2, 301).otherwise(30)
    return read(spark, sf_dir, "events").select(
        "event_id",
        sessions.crawl_request_error(platform, F.lit("u")).alias("crawl_error"),
        sessions.video_request_error(posts, style, seconds).alias("video_error"),
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'video_required' WHEN 1 THEN 'platform_required' WHEN 2 THEN 'platform_unsupported' END AS publish_error,
      event_id % 4 <> 0 AS named, event_id % 4 = 3 AS is_image FROM events"""
)
def publish_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    platforms = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("myspace"))).otherwise(F.array(F.lit("youtube")))
    video = F.when(k == 0, "").otherwise("video-1")
    return read(spark, sf_dir, "events").select(
        "event_id",
        store.publish_errors(video, platforms, F.lit("d"), ["youtube"]).alias("publish_error"),
        records.is_video_id(video).alias("named"),
        records.is_image(F.when(k == 3, "image/png").otherwise("video/mp4")).alias("is_image"),
    )


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN '' ELSE CAST(l_partkey * 9 AS VARCHAR) END AS video_id, l_returnflag AS flag, trim(l_linestatus) AS description FROM lineitem),
      v AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'F' AS done FROM orders)
    SELECT CASE WHEN video_id = '' THEN 'video_required' WHEN flag = 'A' THEN 'platform_required' WHEN flag = 'R' THEN 'platform_unsupported'
      WHEN id IS NULL THEN 'video_missing' WHEN NOT done THEN 'video_unfinished' ELSE 'none' END AS error, count(*) AS n, CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS total
    FROM r LEFT JOIN v ON id = video_id GROUP BY 1"""
)
def publish_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to publish against the videos that are stored: lines as requests, orders as videos."""
    platforms = F.when(F.col("l_returnflag") == "A", F.array().cast("array<string>")).when(F.col("l_returnflag") == "R", F.array(F.lit("weibo"), F.lit("myspace"))).otherwise(F.array(F.lit("weibo")))
    video = F.when(F.col("l_linenumber") > 5, "").otherwise((F.col("l_partkey") * 9).cast("string"))
    asked = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), video.alias("video_id"), platforms.alias("platforms"), F.col("l_linestatus").alias("description")
    )
    videos = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    found = store.with_publish_errors(asked, videos, ["weibo", "douyin", "xiaohongshu", "bilibili"])
    return found.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query(
    """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS username,
        CASE WHEN c_custkey % 4 = 0 THEN 's' || c_custkey || '@x.org' WHEN c_custkey % 4 = 1 THEN 'no address' ELSE 'c' || c_custkey || '@x.org' END AS email FROM customer),
      u AS (SELECT s_name AS username, 's' || s_suppkey || '@x.org' AS email FROM supplier)
    SELECT id, CASE WHEN email = 'no address' THEN 'email:malformed' WHEN username IN (SELECT username FROM u) THEN 'username:taken' WHEN email IN (SELECT email FROM u) THEN 'email:taken' ELSE '' END AS wrong FROM r"""
)
def registration_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations against the users that are stored: customers ask, suppliers are users."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    email = F.when(k % 4 == 0, F.concat(F.lit("s"), k, F.lit("@x.org"))).when(k % 4 == 1, "no address").otherwise(F.concat(F.lit("c"), k, F.lit("@x.org")))
    asked = read(spark, sf_dir, "customer").select(k.alias("id"), name.alias("username"), email.alias("email"), F.lit("abc123").alias("password"), F.lit("abc123").alias("confirm"))
    users = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("username"), F.concat(F.lit("s"), "s_suppkey", F.lit("@x.org")).alias("email"))
    listed = F.array_join(F.transform(F.map_entries("wrong"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return store.with_registration_errors(asked, users).select("id", listed.alias("wrong"))


@query(
    f"""WITH {TASKS_SQL} SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'published' WHEN task_id % 2 = 0 THEN 'processing' ELSE 'pending' END AS status FROM tasks"""
)
def publish_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tasks(spark, sf_dir).select("task_id", (F.col("task_id") % 2 == 0).alias("taken_up"))
    outcomes = asked.filter("task_id % 3 = 0").select("task_id", F.lit("published").alias("outcome"))
    return store.publishing(asked, outcomes).select("task_id", "status")


@query(
    f"""WITH e AS (SELECT l_orderkey AS task_id, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS task_id, CASE WHEN last IS NULL THEN 'pending' WHEN last % 3 = 0 THEN 'completed' WHEN last % 3 = 1 THEN 'running' ELSE 'failed' END AS status,
      CASE WHEN last >= 2 THEN CASE WHEN last % 3 = 2 THEN 'e' || last WHEN last > 2 THEN 'e' || (last - last % 3 - 1) END END AS error FROM orders LEFT JOIN e ON task_id = o_orderkey"""
)
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    last = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    steps = last.select(F.col("l_orderkey").alias("task_id"), F.explode(F.sequence(F.lit(1), "n")).alias("l_linenumber"))
    events = steps.select(
        "task_id",
        k.alias("seq"),
        F.when(k % 3 == 0, "completed").when(k % 3 == 1, "running").otherwise("failed").alias("status"),
        F.when(k % 3 == 2, F.concat(F.lit("e"), k.cast("string"))).otherwise("").alias("error"),
        as_of().alias("at"),
    )
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    return store.with_status(asked, events).select("task_id", "status", "error")


@query(
    f"""SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (1, 2)
    ORDER BY CASE WHEN c_custkey % 11 <> 0 THEN {AS_OF_SQL} - to_minutes(CAST(c_custkey % 500 AS INTEGER)) END NULLS FIRST, c_custkey LIMIT 1"""
)
def scheduled_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls are under way, so one more is taken up."""
    key = F.col("c_custkey")
    creators = read(spark, sf_dir, "customer").select(
        key.alias("id"),
        (key % 3 != 0).alias("auto_crawl_enabled"),
        F.when(key.isin(1, 2), "crawling").otherwise("idle").alias("crawl_status"),
        F.when(key % 11 != 0, as_of() - F.make_dt_interval(mins=(key % 500).cast("int"))).alias("next_crawl_at"),
    )
    return store.taken_up(creators, as_of()).select("id")


@query(
    f"""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'failed' ELSE 'crawling' END AS crawl_status,
      CASE WHEN c_custkey % 3 = 0 THEN {AS_OF_SQL} + INTERVAL 60 MINUTE END AS next_crawl_at, CASE WHEN c_custkey % 3 = 1 THEN 'boom' END AS crawl_error FROM customer"""
)
def crawl_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    creators = read(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.lit(60).alias("crawl_interval"),
        F.lit("crawling").alias("crawl_status"),
        F.lit(None).cast("timestamp_ntz").alias("next_crawl_at"),
        F.lit(None).cast("string").alias("crawl_error"),
    )
    outcomes = creators.filter("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 1, "boom").otherwise("").alias("error"))
    return store.after_crawls(creators, outcomes, as_of()).drop("crawl_interval")


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS kind, event_type || '|b' AS tags FROM events"""
)
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.concat(
        F.lit('{"kind": '),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("17"),
        F.lit(', "tags": ["'),
        "event_type",
        F.lit('", 5, null, "b", {"x": 1}]}'),
    )
    return read(spark, sf_dir, "events").select(
        "event_id", store.string_at(document, "kind").alias("kind"), F.array_join(store.strings_at(document, "tags"), "|").alias("tags")
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, '{"user_id":' || user_id || '}' AS who FROM events"""
)
def documents_as_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.as_texts(read(spark, sf_dir, "events").select("event_id", "ts", F.struct("user_id").alias("who")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (3, 5, 77)")
def selected_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 24, "0").alias("id"))
    wanted = [f"{k:024d}" for k in (3, 5, 77)] + ["ill-formed"]
    return store.selected(rows, wanted).select("o_orderkey")


FILES_SQL = """files AS (SELECT '/data/' || CASE WHEN p_partkey % 3 = 0 THEN p_brand || '/' ELSE '' END || md5(p_name || p_partkey) || '.bin' AS path, CAST(p_size AS BIGINT) AS size FROM part)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("/"))).otherwise("")
    name = F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("/data/"), folder, name, F.lit(".bin")).alias("path"), F.col("p_size").cast("long").alias("size"))


@query(
    f"""WITH {FILES_SQL}, n AS (SELECT '/data/' || string_split(substring(path, 7), '/')[1] AS path, contains(substring(path, 7), '/') AS is_folder, size FROM files),
      g AS (SELECT path, bool_or(is_folder) AS is_folder, CASE WHEN bool_or(is_folder) THEN 0 ELSE max(size) END AS size FROM n GROUP BY 1)
    SELECT *, (SELECT count(*) FROM g) AS total_count FROM g"""
)
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(files(spark, sf_dir), "/data")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE starts_with(path, '/data/Brand') ORDER BY path LIMIT 20")
def files_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prefix(files(spark, sf_dir), "/data/Brand", 0).select("path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE contains(path, 'ab1') ORDER BY path LIMIT 1")
def file_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_hash_in_path(files(spark, sf_dir), "ab1").select("path")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'd' || event_id ELSE 's' || event_id END AS title FROM events"""
)
def response_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, number = F.col("event_id") % 3, F.col("event_id").cast("string")

    def body(before: str, after: str):
        return F.concat(F.lit(before), number, F.lit(after))

    reply = F.when(k == 0, body('{"posts": [{"title": "a', '"}]}')).when(k == 1, body('{"posts": [], "data": [{"title": "d', '"}]}')).otherwise(body('{"total": 1, "title": "s', '"}'))
    found = read(spark, sf_dir, "events").select("event_id", F.inline(response_posts(reply, "struct<title:string>")))
    return found.select("event_id", "title")


@query("SELECT event_type AS metric, event_id, value FROM events WHERE (event_type = 'error' AND value > 5) OR (event_type = 'view' AND value < 1)")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("error", "greater_than", 5.0, "high"), ("view", "less_than", 1.0, "low"), ("click", "other", 0.0, "low")],
        "metric string, comparison string, threshold double, severity string",
    )
    metrics = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    return requests.alerts(metrics, rules).select("metric", "event_id", "value")


@query(
    """WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events)
    SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM w GROUP BY 1"""
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.sliding(read(spark, sf_dir, "events"), "2 hours", "1 hour")


@query("SELECT event_id, user_id FROM events")
def distinct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return requests.distinct_events(events.union(events.filter("event_id % 3 = 0"))).select("event_id", "user_id")


@query(
    f"""WITH {CONTENTS_SQL}, r AS (SELECT id, platform, published_at, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS k FROM contents WHERE platform = 'weibo')
    SELECT id FROM r WHERE k <= 50"""
)
def recent_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One platform's newest posts; a limit that is none stands for 50."""
    posts = store.equal_where_given(contents(spark, sf_dir), platform="weibo")
    return posts.orderBy(F.desc_nulls_last("published_at"), "id").limit(50).select("id")


@query(
    f"""WITH {CONTENTS_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY published_at, id) AS n FROM contents) SELECT id, n FROM r"""
)
def global_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in one order of all rows, undated ones first; numbered by ranges."""
    dated = contents(spark, sf_dir).select("id", "published_at")
    nulls_first = windows.row_numbers(dated, ["published_at", "id"]).select("id", F.col("__n").alias("n"))
    undated = dated.filter("published_at is null").count()
    total = dated.count()
    place = F.when(F.col("n") > undated, F.col("n") - undated).otherwise(F.col("n") + total - undated)
    return nulls_first.select("id", place.alias("n"))


@query(
    f"""WITH {CONTENTS_SQL}, s AS (SELECT count(*) AS contents FROM contents), t AS (SELECT count(*) AS tasks, count(*) FILTER (o_orderstatus = 'O') AS running FROM orders)
    SELECT contents AS store_contents, tasks AS queue_tasks, running AS queue_running FROM s, t"""
)
def system_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "store": contents(spark, sf_dir).agg(F.count("*").alias("contents")),
        "queue": tasks(spark, sf_dir).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "running").alias("running")),
    }
    return sessions.system_stats(parts)


@query("SELECT bool_and(n_nationkey <> 7) AS healthy, string_agg(n_name, '|') FILTER (n_nationkey = 7) AS failing FROM nation")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") != 7).alias("ok"))
    return sessions.health(components).withColumn("failing", F.array_join("failing", "|"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b FROM orders) SELECT id, a, b FROM o"""
)
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")).alias("fields"), as_of().alias("updated_at")
    )
    new = old.filter("id % 2 = 0").select("id", F.create_map(F.lit("a"), F.lit("new")).alias("fields"))
    found = sessions.changed_fields(old, new, "id", as_of())
    return found.select("id", F.col("fields")["a"].alias("a"), F.col("fields")["b"].alias("b"))


@query("SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_acctbal DESC, c_custkey) <= 2 AS leads FROM customer")
def leading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("team"), "c_acctbal")
    rank = F.row_number().over(W.partitionBy("team").orderBy(F.desc("c_acctbal"), "id"))
    top = rows.withColumn("rank", rank).filter("rank <= 2").select("id", F.lit(True).alias("leads"))  # cut before the shuffle
    return rows.join(top, "id", "left").select("id", F.coalesce("leads", F.lit(False)).alias("leads"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'username:too_short' ELSE '' END AS wrong FROM customer"""
)
def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "ab").otherwise(F.col("c_name"))
    errors = store.registration_errors(name, F.lit("a@b.c"), F.lit("abc123"), F.lit("abc123"))
    listed = F.array_join(F.transform(F.map_entries(errors), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), listed.alias("wrong"))


@query("SELECT event_id, CASE WHEN value >= 5 THEN 'high' WHEN value >= 3 THEN 'medium' ELSE 'low' END AS bucket, '每' || (event_id % 90 + 60) // 60 || '小时' AS every FROM events")
def labels_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("event_id") % 90 + 60) * 60_000
    every = text.interval_label(ms, F.lit(""), F.lit(False))
    return read(spark, sf_dir, "events").select("event_id", text.engagement_bucket(F.col("value")).alias("bucket"), every.alias("every"))


@query(
    f"""WITH {CONTENTS_SQL}, p AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', '{n}', '{h}')" for p, n, h in sessions.PLATFORMS) + """) t(platform, display_name, home))
    SELECT platform, display_name, home, count(id) AS n_contents FROM p LEFT JOIN contents USING (platform) GROUP BY ALL"""
)
def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platforms that are known, each with the number of its contents."""
    n = contents(spark, sf_dir).groupBy("platform").agg(F.count("*").alias("n_contents"))
    return sessions.platforms(spark).join(n, "platform", "left").na.fill(0, ["n_contents"])


@query(
    """WITH f AS (SELECT '/in/' || doc_id || '.txt' AS path, md5(text) AS hash FROM documents),
      n AS (SELECT * FROM f WHERE hash NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY path) = 1)
    SELECT path, hash, 'media/' || hash || '_17.txt' AS key FROM n"""
)
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    given = read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.encode("text", "utf-8").alias("content"))
    known = given.filter("doc_id % 10 = 0").select(F.md5("content").alias("hash")).distinct()
    return by_content_hash(given.drop("doc_id"), known, "media", 17).select("path", "hash", "key")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS ended_at, o_orderstatus AS status FROM orders")
def backup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and restored, a time in a nested document too."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.struct((F.col("o_orderdate") + F.expr("interval 1 day")).alias("ended_at"), F.col("o_orderstatus").alias("status")).alias("run"),
    )
    path = own_path(spark, "backup")
    backed_up(rows, path)
    return restored(spark, path, rows.schema).select("id", "created_at", "run.ended_at", "run.status")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey + 100 FROM region")
def seeded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed goes where there are no rows, and nowhere else."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey")
    regions = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"))
    kept = seeded(nations.filter("n_nationkey < 5"), regions)
    return kept.union(seeded(nations.filter("n_nationkey < 0"), regions))


@query(
    f"""WITH {SESSIONS_SQL} SELECT platform, count(*) AS total, count(*) FILTER (coalesce(is_active AND expires_at > {AS_OF_SQL}, false)) AS active,
    count(*) FILTER (coalesce(is_logged_in, false)) AS logged_in FROM (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN is_logged_in END AS is_logged_in) FROM sessions) GROUP BY ROLLUP (platform)"""
)
def instance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = session_rows(spark, sf_dir).withColumn("is_logged_in", F.when(F.col("user_id") % 2 == 0, F.col("is_logged_in")))
    return stats.session_stats(instances, as_of())


@query("SELECT page_id, CASE WHEN length(html) % 2 = 0 THEN CAST(length(html) AS BIGINT) END AS found, CASE WHEN length(html) % 2 = 1 THEN 'odd' END AS error FROM pages")
def page_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    def even(page: str, _: str) -> int:
        if len(page) % 2:
            raise ValueError("odd")
        return len(page)

    return html.attempted(read(spark, sf_dir, "pages"), even, "bigint")
