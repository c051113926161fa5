"""Queries over stored records: nested documents, restores, searches, deletes, counts of changes, overviews, parts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from siftline.functions import html
from siftline.operators import stats, store
from siftline.plans.addresses import listed, listed_sql
from siftline.plans.registry import PLATFORMS, as_of, query
from siftline.sources.shared import own_path
from siftline.sources.tables import backed_up, bad_times, listing, objects, restored
from siftline.sources.tables import table as read


@query(
    """WITH e AS (SELECT event_id, user_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS written, ts FROM events)
    SELECT event_id, event_id || '@' || written || ',' || user_id || '@' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS seen,
    strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') AS day, md5(CAST(user_id AS VARCHAR)) AS hash FROM e"""
)
def nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents: times in a list and in a map, and a binary id, become texts in their places."""
    id_at, user_at = ((F.col("event_id"), F.col("ts")), (F.col("user_id"), F.date_trunc("second", "ts")))
    events = read(spark, sf_dir, "events").select(
        "event_id",
        F.array(*(F.struct(at.alias("at"), of.alias("id")) for of, at in (id_at, user_at))).alias("seen"),
        F.create_map(F.lit("day"), F.date_trunc("day", "ts")).alias("times"),
        F.struct(F.unhex(F.md5(F.col("user_id").cast("string"))).alias("hash")).alias("who"),
    )
    seen = F.array_join(F.transform("seen", lambda x: F.concat(x["id"].cast("string"), F.lit("@"), x["at"])), ",")
    return store.texted(events).select("event_id", seen.alias("seen"), F.col("times")["day"].alias("day"), F.col("who.hash").alias("hash"))


BACKUP = StructType([
    StructField("id", StringType()), StructField("created_at", TimestampNTZType()),
    StructField("run", StructType([StructField("endedAt", TimestampNTZType()), StructField("status", StringType())])),
])


def written_badly(spark: SparkSession, sf_dir: str) -> str:
    """A backup of orders in which some times are none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    ended = F.when(F.col("o_orderpriority").startswith("5"), F.concat(F.lit("after "), day)).otherwise(day)
    created = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(day)
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), created.alias("created_at"), F.struct(ended.alias("endedAt"), F.col("o_orderstatus").alias("status")).alias("run")
    )
    path = own_path(spark, "backup")
    backed_up(rows, path)
    return path


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS created_at,
    CASE WHEN NOT starts_with(o_orderpriority, '5') THEN CAST(o_orderdate AS TIMESTAMP) END AS "endedAt", o_orderstatus AS status FROM orders"""
)
def restored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(spark, written_badly(spark, sf_dir), BACKUP).select("id", "created_at", "run.endedAt", "run.status")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'created_at' AS field, 'soon' AS text FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'run.endedAt', 'after ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders WHERE starts_with(o_orderpriority, '5')"""
)
def restored_bad_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand where a time should: none is lost by the restore."""
    return bad_times(spark, written_badly(spark, sf_dir), BACKUP, ["id"])


@query(
    """SELECT count(*) AS matched, count(*) FILTER (conv_id % 3 = 0 AND role <> 'user') AS modified FROM
    (SELECT conv_id, turn, min(role) AS role FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)"""
)
def read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages a user's request to mark all as read finds, and how many it changes."""
    one = read(spark, sf_dir, "conversations").filter("role is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.count("*").alias("n"))
    notes = one.filter("n = 1").select(
        F.col("conv_id").alias("session_id"), "turn", (F.col("role") == "user").alias("read"), F.lit(None).cast("timestamp_ntz").alias("read_at")
    )
    mine = notes.select("session_id").distinct().filter("session_id % 3 = 0").select(
        "session_id", F.lit(True).alias("is_active"), F.lit(None).cast("timestamp_ntz").alias("expires_at")
    )
    return store.modified(notes, store.marked_read(notes, mine, as_of()), ["session_id", "turn"])


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey = (SELECT min(o_orderkey) FROM orders) AND o_custkey = 899)")
def owned_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order goes only if it is that customer's; it isn't everywhere."""
    orders = read(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    return store.without_owned(orders, first, 899, "o_orderkey", "o_custkey").select("o_orderkey")


@query(
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, {listed_sql(PLATFORMS, "l_suppkey + l_linenumber")} AS platform FROM lineitem)
    SELECT platform, count(*) AS kept, count(*) FILTER (l_suppkey = 1) AS of_instance FROM c WHERE NOT (l_suppkey = 1 AND platform = 'weibo') GROUP BY 1"""
)
def instance_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left by platform once an instance's rows of one platform are gone."""
    rows = read(spark, sf_dir, "lineitem").withColumn("platform", listed(PLATFORMS, F.col("l_suppkey") + F.col("l_linenumber")))
    kept = store.without_instance(rows, 1, "weibo", "l_suppkey")
    return kept.groupBy("platform").agg(F.count("*").alias("kept"), F.count_if(F.col("l_suppkey") == 1).alias("of_instance"))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' AND contains(lower(p_name), 'ring') AND l_suppkey = 7")
def filtered_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of one status and creator by words of their title."""
    titles = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    videos = read(spark, sf_dir, "lineitem").join(titles, "l_partkey").withColumns({"status": F.col("l_linestatus"), "creator_id": F.col("l_suppkey").cast("string")})
    return store.searched_videos(videos, "Ring", "O", "7").select("l_orderkey", "l_linenumber", F.col("title").alias("p_name"))


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')) AND p_brand = 'Brand#2'")
def filtered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one category by words of their name and description."""
    items = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS name", "p_type AS description", "p_brand AS category")
    return store.searched_items(items, "SMALL", "Brand#2").select("p_partkey", F.col("name").alias("p_name"))


GROWTH_SQL = ", ".join(f"round((CAST({n} AS DOUBLE) - CAST({n}_before AS DOUBLE)) * 100 / nullif(CAST({n}_before AS DOUBLE), 0), 4) AS {n}_growth" for n in ("posts", "views", "engagement", "revenue"))


@query(
    f"""WITH p AS (SELECT {listed_sql(PLATFORMS, "l_suppkey")} AS platform, date_diff('second', CAST(l_shipdate AS TIMESTAMP), TIMESTAMP '1999-06-01') AS age, CAST(l_quantity AS DECIMAL(18,2)) AS v,
      CAST(l_quantity * l_linenumber AS DECIMAL(18,2)) AS e, CAST(l_extendedprice AS DECIMAL(18,2)) AS r FROM lineitem),
    x AS (SELECT *, age < days * 86400 AS now FROM p, (VALUES (1), (7), (30), (90)) t(days) WHERE age >= 0 AND age < 2 * days * 86400),
    g AS (SELECT days, platform, count(*) FILTER (now) AS posts, count(*) FILTER (NOT now) AS posts_before, coalesce(sum(v) FILTER (now), 0) AS views, coalesce(sum(e) FILTER (now), 0) AS engagement,
      coalesce(sum(r) FILTER (now), 0) AS revenue, sum(v) FILTER (NOT now) AS views_before, sum(e) FILTER (NOT now) AS engagement_before, sum(r) FILTER (NOT now) AS revenue_before
      FROM x GROUP BY GROUPING SETS ((days, platform), (days)))
    SELECT CAST(days AS INTEGER) AS days, platform, posts, CAST(views AS DOUBLE) AS views, CAST(engagement AS DOUBLE) AS engagement, CAST(revenue AS DOUBLE) AS revenue,
      round(CAST(engagement AS DOUBLE) * 100 / nullif(CAST(views AS DOUBLE), 0), 4) AS engagement_rate, {GROWTH_SQL} FROM g"""
)
def analytics_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, views, engagement and revenue by platform for a day, a week, a month and a quarter, against the ones before."""
    money = "decimal(18,2)"
    posts = read(spark, sf_dir, "lineitem").select(
        listed(PLATFORMS, F.col("l_suppkey")).alias("platform"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"),
        F.col("l_quantity").cast(money).alias("views"), (F.col("l_quantity") * F.col("l_linenumber")).cast(money).alias("engagement"),
        F.col("l_extendedprice").cast(money).alias("revenue"),
    )
    found = stats.overviews(posts, F.lit("1999-06-01").cast("timestamp_ntz"))
    return found.withColumns({c: F.col(c).cast("double") for c in ("views", "engagement", "revenue")})


@query(
    " UNION ALL ".join(f"SELECT 'count' AS kind, '{t}' AS name, count(*) AS value FROM {t}" for t in ("customer", "orders", "events", "documents"))
    + " UNION ALL (SELECT 'creator', c_name, c_custkey FROM customer ORDER BY c_custkey LIMIT 3)"
)
def database_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("customer", "orders", "events", "documents")}
    return stats.database_status(tables, tables["customer"], "c_custkey", "c_name")


#: Pages whose links are pictures, and that say what they are in their heads.
PICTURED_SQL = """pictured AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract_all(html, '<a href="([^"]+)"', 1) AS links FROM pages)"""


def pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    head = F.concat(F.lit('<head><meta name="description" content="about '), path, F.lit('"><meta property="og:url" content="'), path, F.lit('"><meta name="description" content="again">'))
    page = F.replace(F.replace("html", F.lit("<a href="), F.lit("<img alt=x src=")), F.lit("<head>"), head)
    return read(spark, sf_dir, "pages").select("page_id", "url", page.alias("html"))


@query(
    f"""WITH {PICTURED_SQL}, l AS (SELECT page_id, origin, unnest(links) AS link, generate_subscripts(links, 1) AS k FROM pictured),
    w AS (SELECT page_id, k, CASE WHEN starts_with(link, '/') THEN origin || link ELSE link END AS picture FROM l)
    SELECT page_id, array_to_string(list(picture ORDER BY k), '|') AS pictures FROM w WHERE NOT regexp_matches(lower(picture), 'icon|logo|avatar|button') GROUP BY 1"""
)
def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of each page by whole addresses, but for decoration."""
    found = html.page_extract(pictured(spark, sf_dir))
    return found.filter(F.size("images") > 0).select("page_id", F.array_join(F.transform("images", lambda x: x["url"]), "|").alias("pictures"))


@query(
    f"""WITH {PICTURED_SQL} SELECT page_id, 'about ' || path AS description, path AS og_url, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pictured"""
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says about itself: the first value of each name."""
    meta = F.col("metadata")
    names = {"description": "meta_description", "og_url": "meta_og:url", "url": "url", "domain": "domain"}
    return html.page_extract(pictured(spark, sf_dir)).select("page_id", *(meta[key].alias(name) for name, key in names.items()))


def written_events(spark: SparkSession, sf_dir: str) -> str:
    """Events in the shared folder, in a folder by kind and one by day below it."""
    path = own_path(spark, "objects")
    read(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day")).write.partitionBy("event_type", "day").parquet(path)
    return path


@query(
    """WITH d AS (SELECT DISTINCT 'event_type=click/day=' || strftime(ts, '%Y-%m-%d') AS folder FROM events WHERE event_type = 'click')
    SELECT folder, true AS is_folder, CAST(0 AS BIGINT) AS size, (SELECT count(*) FROM d) AS total_count FROM d"""
)
def stored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies right in one folder of real files: a folder for each day, of size 0."""
    path = written_events(spark, sf_dir)
    files = objects(spark, path, prefix="event_type=click/")
    at = F.expr("substring(path, 1, instr(path, '/event_type=') - 1)")
    rooted = files.withColumn("path", F.replace("path", at, F.lit("")))
    return listing(rooted, "/event_type=click").select(F.substring("path", 2, 1 << 20).alias("folder"), "is_folder", "size", "total_count")


@query(
    """SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error' AND strftime(ts, '%d') < '10' AND
    strftime(ts, '%Y-%m') = (SELECT min(strftime(ts, '%Y-%m')) FROM events)"""
)
def objects_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of stored files that one prefix finds: errors of the first nine days of the first month."""
    path = written_events(spark, sf_dir)
    month = read(spark, sf_dir, "events").agg(F.min(F.date_format("ts", "yyyy-MM"))).first()[0]
    files = objects(spark, path, prefix=f"event_type=error/day={month}-0")
    parts = (F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name) for name in ("event_type", "day"))
    return files.select(*parts).distinct()
