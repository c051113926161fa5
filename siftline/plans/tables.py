"""Queries over operational tables: ranking, joins, statistics, windows, updates.

Customers stand for creators, orders for tasks (O running, F completed, P pending), line items for
contents, events for requests and sessions.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import times
from siftline.operators import dedup, stats, store, windows
from siftline.plans.registry import AS_OF, CONTENTS_SQL, as_of, contents, query
from siftline.sources.tables import inserted_if_missing, table, upserted
from siftline.streaming import requests

STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'pending' END"
PLATFORM_OF = "list_extract(['weibo', 'bilibili', 'xiaohongshu', 'douyin', 'news'], CAST({} % 5 AS INTEGER) + 1)"


def platform_by(number: str):
    return F.get(F.array(*map(F.lit, ["weibo", "bilibili", "xiaohongshu", "douyin", "news"])), (F.col(number) % 5).cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("creator_id"),
        status.alias("status"),
        platform_by("o_custkey").alias("platform"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("cost"),
    )


TASKS_SQL = f"""tasks AS (SELECT o_orderkey AS task_id, o_custkey AS creator_id, {STATUS_SQL} AS status,
  {PLATFORM_OF.format('o_custkey')} AS platform, o_orderdate AS created_at, o_totalprice AS cost FROM orders)"""

#: Sessions: one for each user and day; active if the last event was no error, logged in if a signup was among them.
SESSIONS_SQL = f"""sessions AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id,
  {PLATFORM_OF.format('user_id')} AS platform, bool_or(event_type = 'signup') AS is_logged_in, count(*) % 2 = 0 AS is_active,
  max(ts) AS last_activity, CASE WHEN count(*) % 5 <> 0 THEN max(ts) + INTERVAL 15 DAY END AS expires_at
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    found = events.groupBy("user_id", "day").agg(
        F.bool_or(F.col("event_type") == "signup").alias("is_logged_in"),
        (F.count("*") % 2 == 0).alias("is_active"),
        F.max("ts").alias("last_activity"),
        F.when(F.count("*") % 5 != 0, F.max("ts") + F.expr("interval 15 days")).alias("expires_at"),
    )
    name = F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string"))
    return found.select(name.alias("session_id"), "user_id", platform_by("user_id").alias("platform"), *found.columns[2:])


@query(f"WITH {TASKS_SQL} SELECT task_id, status, created_at FROM tasks ORDER BY created_at DESC, task_id LIMIT 50")
def recent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", "status", "created_at").orderBy(F.desc("created_at"), "task_id").limit(50)


@query(f"WITH {TASKS_SQL} SELECT task_id, status FROM tasks WHERE platform = 'weibo' ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 40")
def paged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.equal_where_given(tasks(spark, sf_dir), platform="weibo", status="")
    return found.orderBy(F.desc("created_at"), "task_id").offset(40).limit(20).select("task_id", "status")


@query(
    f"""WITH {CONTENTS_SQL} SELECT platform, id, published_at FROM contents
    QUALIFY row_number() OVER (PARTITION BY platform ORDER BY published_at DESC NULLS LAST, id) <= 10"""
)
def posts_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.row_number().over(W.partitionBy("platform").orderBy(F.desc_nulls_last("published_at"), "id"))
    return contents(spark, sf_dir).withColumn("rank", newest).filter("rank <= 10").select("platform", "id", "published_at")


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, platform FROM contents WHERE platform = 'douyin'
    AND (coalesce(contains(lower(title), 'that'), false) OR coalesce(contains(lower(content), 'that'), false))"""
)
def search_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.searched(contents(spark, sf_dir), "That", platform="douyin").select("id", "platform")


@query(
    f"""WITH {TASKS_SQL} SELECT creator_id, platform, count(*) AS n FROM tasks WHERE status IN ('pending', 'running')
    GROUP BY ALL HAVING count(*) > 1"""
)
def task_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = tasks(spark, sf_dir).filter(F.col("status").isin("pending", "running"))
    return waiting.groupBy("creator_id", "platform").agg(F.count("*").alias("n")).filter("n > 1")


@query(
    f"""WITH c AS (SELECT c_custkey, c_acctbal > 0 AS auto, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'crawling' ELSE 'idle' END AS status,
      CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey AS INTEGER)) END AS next_at FROM customer)
    SELECT c_custkey FROM c WHERE auto AND (status IS NULL OR status <> 'crawling') AND (next_at IS NULL OR next_at <= TIMESTAMP '{AS_OF}')"""
)
def due_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    status = F.when(key % 7 == 0, F.lit(None)).when(key % 3 == 0, "crawling").otherwise("idle")
    next_at = F.when(key % 11 != 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=key.cast("int")))
    return table(spark, sf_dir, "customer").filter(store.is_due(F.col("c_acctbal") > 0, status, next_at, as_of())).select("c_custkey")


@query(
    """SELECT o_orderkey, coalesce(c_name, '未知创作者') AS c_name FROM orders
    LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey"""
)
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", "c_name")
    return store.looked_up(orders, known, "c_custkey", "c_name", "未知创作者").select("o_orderkey", "c_name")


@query(
    """WITH t AS (SELECT o_custkey AS team_id, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1),
      m AS (SELECT team_id, unnest(list_slice(ids, 1, 3)) AS id FROM t)
    SELECT team_id, coalesce(array_to_string(list(p_name ORDER BY id), '|'), '') AS names FROM m LEFT JOIN part ON p_partkey = id % 500 + 1 GROUP BY 1"""
)
def member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("team_id").orderBy("o_orderkey"))  # cut before the shuffle, as only the first three count
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team_id"), "o_orderkey").withColumn("rank", rank).filter("rank <= 3")
    teams = orders.groupBy("team_id").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    teams = teams.select("team_id", F.transform("orders", lambda x: x % 500 + 1).alias("member_ids"))
    people = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))
    return store.members_named(teams, people).select("team_id", F.array_join("names", "|").alias("names"))


@query(
    f"""WITH {SESSIONS_SQL} SELECT event_id FROM events WHERE CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) IN
    (SELECT session_id FROM sessions WHERE is_active AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}'))"""
)
def semi_valid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = sessions(spark, sf_dir).filter(store.is_valid_session(F.col("is_active"), F.col("expires_at"), as_of()))
    named = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", named.alias("session_id"))
    return events.join(valid, "session_id", "left_semi").select("event_id")


@query(
    f"""WITH {TASKS_SQL} SELECT l_orderkey AS task_id, count(*) AS n FROM lineitem
    WHERE l_orderkey NOT IN (SELECT task_id FROM tasks WHERE status = 'completed') GROUP BY 1"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_tasks = tasks(spark, sf_dir)
    gone = all_tasks.filter("status = 'completed'").select("task_id")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"))
    return store.cascaded(all_tasks, items, gone, "task_id")[1].groupBy("task_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SESSIONS_SQL} SELECT platform, count(*) AS total, count(*) FILTER (coalesce(is_active AND expires_at > TIMESTAMP '{AS_OF}', false)) AS active,
    count(*) FILTER (is_logged_in) AS logged_in FROM sessions GROUP BY ROLLUP (platform)"""
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.session_stats(sessions(spark, sf_dir), as_of())


@query(
    f"""WITH {TASKS_SQL} SELECT status, platform, count(*) AS n, CAST(grouping(status, platform) AS BIGINT) AS level FROM tasks
    GROUP BY GROUPING SETS ((status), (platform), ())"""
)
def status_platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_status_and_platform(tasks(spark, sf_dir))


@query(f"WITH {SESSIONS_SQL} SELECT platform, count(*) AS n, max(last_activity) AS last_updated FROM sessions GROUP BY 1")
def cookie_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest_by_platform(sessions(spark, sf_dir).withColumnRenamed("last_activity", "updated_at"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors,
    (SELECT round(avg(value), 4) FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)) AS mean_latency FROM events"""
)
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.request_metrics(table(spark, sf_dir, "events"))


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events", "documents"))
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "orders", "lineitem", "events", "documents")
    return stats.table_counts({t: table(spark, sf_dir, t) for t in names})


@query(
    """SELECT event_id, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) OVER w AS DOUBLE) / count(*) OVER w / 1000000 AS mean FROM events
    WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"""
)
def latency_ma1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole millionths add up to the same sum in any order
    micros = F.round(F.col("value") * 1_000_000).cast("long").alias("value")
    found = windows.moving_mean(table(spark, sf_dir, "events").select("event_id", "ts", micros), "value", ["ts", "event_id"])
    return found.select("event_id", (F.col("mean") / 1_000_000).alias("mean"))


@query(
    """WITH r AS (SELECT l_orderkey AS task_id, l_returnflag <> 'R' AS ok, 'line ' || l_linenumber AS message FROM lineitem WHERE l_orderkey % 5 <> 0),
      f AS (SELECT task_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
        string_agg(message, '|' ORDER BY message) FILTER (NOT ok) AS errors FROM r GROUP BY 1),
      c AS (SELECT o_orderkey AS task_id, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(errors, '') AS errors
        FROM orders LEFT JOIN f ON f.task_id = o_orderkey)
    SELECT *, CASE WHEN failed = 0 THEN 'published' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM c"""
)
def publish_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0").select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") != "R").alias("ok"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("message")
    )
    all_tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    found = stats.publish_outcome(results, all_tasks, "task_id", "ok", "message")
    return found.withColumn("errors", F.array_join("errors", "|"))


@query(
    """WITH e AS (SELECT event_type, value, ts > TIMESTAMP '2024-01-28' - INTERVAL 7 DAY AS now FROM events
      WHERE ts > TIMESTAMP '2024-01-28' - INTERVAL 14 DAY AND ts <= TIMESTAMP '2024-01-28'),
      a AS (SELECT event_type, count(*) FILTER (now) AS n, count(*) FILTER (NOT now) AS n_before, round(sum(value) FILTER (now), 4) AS value FROM e GROUP BY 1)
    SELECT *, CASE WHEN n_before > 0 THEN round((n - n_before) * 100.0::DOUBLE / n_before, 4) END AS growth FROM a"""
)
def analytics_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview(table(spark, sf_dir, "events"), F.lit("2024-01-28").cast("timestamp_ntz"), 7)


@query(
    """SELECT l_partkey, views, CAST(row_number() OVER (ORDER BY views DESC, l_partkey) AS BIGINT) AS rank
    FROM (SELECT l_partkey, count(*) AS views FROM lineitem GROUP BY 1) ORDER BY views DESC, l_partkey LIMIT 20"""
)
def top_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "l_partkey").limit(20)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("views"), "l_partkey")).cast("long"))


@query(
    """SELECT conv_id, turn, role, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 5"""
)
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.last_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", 5)
    return found.select("conv_id", "turn", "role", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {SESSIONS_SQL}, r AS (SELECT session_id, platform, row_number() OVER (PARTITION BY platform ORDER BY last_activity, session_id) AS k,
      count(*) OVER (PARTITION BY platform) AS n FROM sessions) SELECT session_id, platform FROM r WHERE k <= n - 4"""
)
def evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evicted(sessions(spark, sf_dir), "platform", ["last_activity", "session_id"]).select("session_id", "platform")


@query(
    """WITH s AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events),
      l AS (SELECT *, lag(ok, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
    SELECT event_id, user_id, ok, before FROM l WHERE ok <> before"""
)
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return windows.status_changes(events, "user_id", ["ts", "event_id"], "ok").drop("ts")


@query(
    f"""WITH {CONTENTS_SQL} SELECT id, coalesce(published_at, TIMESTAMP '{AS_OF}' - to_hours(CAST(row_number() OVER (PARTITION BY platform ORDER BY pos) AS INTEGER))) AS published_at FROM contents"""
)
def default_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dated(contents(spark, sf_dir), "published_at", as_of(), "pos", "platform").select("id", "published_at")


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'no time' END AS s FROM events)
    SELECT event_id, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y/%m/%d %H:%M:%S'),
      try_strptime(s, '%Y-%m-%d')) AS at FROM t"""
)
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, ts = F.col("event_id") % 5, F.col("ts")
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd"]
    text = F.lit("no time")
    for k, f in enumerate(formats):
        text = F.when(kind == k, F.date_format(ts, f)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", times.parse_time(text).alias("at"))


@query(
    f"""WITH t AS (SELECT event_id, event_id % 50 + 1 AS n, event_id % 5 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN TIMESTAMP '{AS_OF}' - to_minutes(CAST(n AS INTEGER)) WHEN 1 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(n AS INTEGER))
      WHEN 2 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(n AS INTEGER)) WHEN 3 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY END AS at FROM t"""
)
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 50 + 1).cast("string")
    text = F.lit("很久以前")
    for k, tail in enumerate(("分钟前", "小时前", "天前")):
        text = F.when(F.col("event_id") % 5 == k, F.concat(n, F.lit(tail))).otherwise(text)
    text = F.when(F.col("event_id") % 5 == 3, "昨天 10:00").otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", times.relative_time(text, as_of()).alias("at"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      r AS (SELECT user_id, event_id, k, ts AS start, 1 AS n, CAST(NULL AS TIMESTAMP) AS until, true AS accepted FROM e WHERE k = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.k,
          CASE WHEN coalesce(e.ts < r.until, false) THEN r.start WHEN e.ts - r.start >= INTERVAL 1 DAY THEN e.ts ELSE r.start END,
          CASE WHEN coalesce(e.ts < r.until, false) THEN r.n WHEN e.ts - r.start >= INTERVAL 1 DAY THEN 1 ELSE r.n + 1 END,
          CASE WHEN coalesce(e.ts < r.until, false) THEN r.until WHEN e.ts - r.start >= INTERVAL 1 DAY THEN NULL
            WHEN r.n + 1 > 3 THEN e.ts + INTERVAL 1 DAY ELSE r.until END,
          CASE WHEN coalesce(e.ts < r.until, false) THEN false WHEN e.ts - r.start >= INTERVAL 1 DAY THEN true ELSE r.n + 1 <= 3 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT user_id, event_id, accepted FROM r"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_limited(table(spark, sf_dir, "events"), "user_id", 3, timedelta(days=1))


@query(
    f"""WITH {TASKS_SQL}, u AS (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'failed' ELSE '' END AS status FROM tasks WHERE task_id % 4 < 2)
    SELECT t.task_id, coalesce(nullif(u.status, ''), t.status) AS status FROM tasks t LEFT JOIN u ON u.task_id = t.task_id"""
)
def apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tasks(spark, sf_dir).select("task_id", "status")
    new = old.filter("task_id % 4 < 2").select("task_id", F.when(F.col("task_id") % 2 == 0, "failed").otherwise("").alias("status"))
    return store.updated(old, new, "task_id", ["status"])


@query(
    """SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN true END, false) OR conv_id % 3 = 0 AS read FROM conversations"""
)
def mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "user", True).alias("read"), F.lit(None).cast("timestamp_ntz").alias("read_at")
    )
    mine = notes.select("session_id").distinct().filter("session_id % 3 = 0").select(
        "session_id", F.lit(True).alias("is_active"), F.lit(None).cast("timestamp_ntz").alias("expires_at")
    )
    marked = store.marked_read(notes, mine, as_of())
    return marked.select(F.col("session_id").alias("conv_id"), "turn", F.coalesce("read", F.lit(False)).alias("read"))


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(regexp_matches(c_name, '(?i)customer#0*1'), false)")
def delete_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(table(spark, sf_dir, "customer"), F.col("c_name").rlike("(?i)customer#0*1")).select("c_custkey")


@query(
    """WITH b AS (SELECT o_custkey AS k, o_orderdate AS updated_at, o_totalprice AS v, o_orderkey AS o, o_orderkey % 2 AS new FROM orders),
      d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k, new ORDER BY updated_at DESC, o DESC) = 1)
    SELECT k, v FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC, new DESC) = 1"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("o")
    )
    sides = [dedup.keep_first(rows.filter(f"o % 2 = {x}"), ["k"], [F.desc("updated_at"), F.desc("o")]) for x in (0, 1)]
    return upserted(sides[0], sides[1], ["k"]).select("k", "v")


@query(
    """SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 10
    UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey >= 10"""
)
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"))
    return inserted_if_missing(old, new, "k")


@query(
    f"""WITH {TASKS_SQL} SELECT task_id FROM tasks WHERE NOT (status = 'completed' AND created_at < (SELECT max(created_at) FROM tasks) - INTERVAL 7 DAY)"""
)
def sweep_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks(spark, sf_dir).withColumnRenamed("created_at", "completed_at")
    newest = found.agg(F.max("completed_at").alias("newest"))
    swept = found.crossJoin(F.broadcast(newest))  # one row
    return store.without(swept, store.expired_tasks(swept, F.col("newest"))).select("task_id")


@query(
    """WITH r AS (SELECT user_id AS page_id, event_type, value FROM events)
    SELECT page_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('click', 'purchase')) AS xhr,
      count(*) FILTER (event_type = 'view') AS images, count(*) FILTER (event_type = 'error') > count(*) * 0.3 AS advised FROM r GROUP BY 1"""
)
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    given = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"),
        F.when(kind.isin("click", "purchase"), "xhr").when(kind == "view", "image").otherwise("document").alias("resource_type"),
        F.lit("GET").alias("method"),
        F.lit("https://example.com/page").alias("url"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.lit(None).cast("double").alias("response_time"),
        F.lit("news").alias("platform"),
    )
    silent = given.filter(F.lit(False)).select("page_id", F.lit("").alias("type"), F.lit("").alias("text"))
    found = stats.network_advice(stats.network_summary(given, silent, "page_id"))
    return found.select("page_id", "total", "failed", "xhr", "images", F.array_contains("advice", "many_failures").alias("advised"))


@query(
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.sessions(table(spark, sf_dir, "events"), "2 hours").select("user_id", "start", "n")
