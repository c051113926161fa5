"""Sessions, instances, cookies and configuration: folds, expiry, decryption, merging, nesting, requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import is_valid_session

# The platforms that are known, with names and addresses.
PLATFORMS = [
    ("weibo", "微博", "https://weibo.com"),
    ("bilibili", "哔哩哔哩", "https://www.bilibili.com"),
    ("xiaohongshu", "小红书", "https://www.xiaohongshu.com"),
    ("douyin", "抖音", "https://www.douyin.com"),
    ("news", "新闻", ""),
    ("general", "通用", ""),
]
SUPPORTED_SITES = ["youtube", "twitter", "instagram", "tiktok"]
VIDEO_STYLES = ["news", "vlog", "story"]


def platforms(spark: SparkSession) -> DataFrame:
    """The platform dimension: six rows."""
    return spark.createDataFrame(PLATFORMS, "platform string, display_name string, home string")


def logins(sessions: DataFrame, instances: DataFrame) -> DataFrame:
    """Each session with its instances folded: logged in if one is; the first user name by instance id."""
    folded = instances.groupBy("session_id").agg(
        F.bool_or("is_logged_in").alias("any_logged_in"),
        F.min_by("login_user", F.when(F.col("login_user").isNotNull(), F.col("instance_id"))).alias("login_user"),
        F.count("*").alias("n_instances"),
    )
    return sessions.join(folded, "session_id", "left").withColumns(
        {"any_logged_in": F.coalesce("any_logged_in", F.lit(False)), "n_instances": F.coalesce("n_instances", F.lit(0))}
    )


def split_expired(sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, expired) sessions."""
    valid = F.coalesce(is_valid_session(F.col("is_active"), F.col("expires_at"), as_of), F.lit(False))
    return sessions.filter(valid), sessions.filter(~valid)


def closed(instances: DataFrame, gone: Column, as_of: Column) -> DataFrame:
    """Instances that are gone become inactive, closed now; those closed before keep their time."""
    hit = F.coalesce(gone, F.lit(False)) & F.col("is_active")
    return instances.withColumn("closed_at", F.when(hit, as_of).otherwise(F.col("closed_at"))).withColumn(
        "is_active", F.col("is_active") & ~hit
    )


def logged_in(sessions: DataFrame, news: DataFrame, as_of: Column) -> DataFrame:
    """Sessions by the last news of their login (columns: session_id, seq, is_logged_in, login_user), active from now on."""
    last = news.groupBy("session_id").agg(F.max_by(F.struct("is_logged_in", "login_user"), "seq").alias("__last"))
    hit = sessions.join(last, "session_id", "left")
    told = F.col("__last").isNotNull()
    return hit.withColumns(
        {
            "is_logged_in": F.when(told, F.col("__last.is_logged_in")).otherwise(F.col("is_logged_in")),
            "login_user": F.when(told, F.coalesce("__last.login_user", "login_user")).otherwise(F.col("login_user")),
            "last_activity": F.when(told, as_of).otherwise(F.col("last_activity")),
        }
    ).select(sessions.columns)


def restored_cookies(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Cookie rows of a backup, still encrypted; missing times become now, a missing end so many days from now."""
    until = as_of + F.make_dt_interval(days=F.lit(days))
    now = {c: F.coalesce(c, as_of) for c in ("created_at", "updated_at")}
    return rows.withColumns(now | {"expires_at": F.coalesce("expires_at", until)})


def without_sessions(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows that belong to no session that is gone."""
    return rows.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def extended(sessions: DataFrame, ids: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Sessions that are asked for expire so many hours from now, whatever they had left."""
    hit = sessions.join(ids.select("session_id").distinct().withColumn("__hit", F.lit(True)), "session_id", "left")
    until = as_of + F.make_dt_interval(hours=F.lit(hours))
    return hit.withColumn("expires_at", F.when(F.col("__hit"), until).otherwise(F.col("expires_at"))).select(sessions.columns)


def sealed(cookies: DataFrame, key: str) -> DataFrame:
    """Cookie rows with their array of cookies encrypted."""
    text = F.base64(F.aes_encrypt(F.to_json("cookies"), F.lit(key)))
    return cookies.withColumn("encrypted_cookies", text).drop("cookies")


def opened(rows: DataFrame, key: str, as_of: Column, platform: str = "", domain: str = "") -> DataFrame:
    """One row a cookie of the rows that haven't expired; rows that can't be read are left out."""
    fresh = rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
    for name, value in (("platform", platform), ("domain", domain)):
        fresh = fresh.filter(F.col(name) == value) if value else fresh
    text = F.try_aes_decrypt(F.unbase64("encrypted_cookies"), F.lit(key)).cast("string")
    cookies = F.from_json(text, "array<struct<name:string,value:string>>")
    return fresh.select("browser_instance_id", "platform", "domain", F.inline(cookies))


def merged_config(wanted: DataFrame, browser: DataFrame, local: DataFrame) -> DataFrame:
    """For each row of (platform, config): the browser's configuration, else the local one, else none; own values win."""
    sides = wanted.join(browser.withColumnRenamed("config", "__browser"), "platform", "left").join(
        local.withColumnRenamed("config", "__local"), "platform", "left"
    )
    empty = F.create_map().cast("map<string,string>")
    base = F.coalesce("__browser", "__local", empty)
    own = F.coalesce("config", empty)
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return sides.withColumn("config", F.map_concat(kept, own)).drop("__browser", "__local")


def changed_fields(old: DataFrame, new: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Free-form updates: new map entries over old ones, with the time of the change."""
    fresh = new.select(key, F.col("fields").alias("__new"))
    both = old.join(fresh, key, "left")
    kept = F.map_filter("fields", lambda k, _: ~F.map_contains_key(F.col("__new"), k))
    stamped = F.map_concat(kept, "__new")
    return both.withColumn("updated_at", F.when(F.col("__new").isNotNull(), as_of).otherwise(F.col("updated_at"))).withColumn(
        "fields", F.when(F.col("__new").isNotNull(), stamped).otherwise(F.col("fields"))
    ).drop("__new")


def crawl_requests(creators: DataFrame, limit: int = 20) -> DataFrame:
    """One request a creator: for its profile, or its user name without one."""
    target = F.coalesce(F.nullif("profile_url", F.lit("")), F.col("username"))
    return creators.select(target.alias("creator_url"), "platform", F.lit(limit).alias("limit"))


def nested(items: DataFrame, category: str, name: str) -> DataFrame:
    """Categories with their items, by name."""
    return items.groupBy(category).agg(F.array_sort(F.collect_set(name)).alias("items"))


def evicted_everywhere(instances: DataFrame, order: list[str], cap: int = 20) -> DataFrame:
    """The least recently used of all instances that stand in the way of one more. ``order`` tells rows apart.

    The newest ones that stay are few; what is older than all of them goes, without a window over all rows.
    """
    place = F.struct(*order)
    newest = instances.orderBy(*(F.desc(c) for c in order)).limit(cap - 1).agg(F.min(place).alias("__oldest_kept"))
    return instances.crossJoin(F.broadcast(newest)).filter(place < F.col("__oldest_kept")).drop("__oldest_kept")


def system_stats(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of one-row statistics, columns prefixed by part."""
    named = [df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns)) for name, df in parts.items()]
    return reduce(DataFrame.crossJoin, named)


def health(components: DataFrame) -> DataFrame:
    """Healthy if every component is; with the names of those that aren't."""
    bad = F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("name"))))
    return components.agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("healthy"), bad.alias("failing"))


def crawl_request_error(platform: Column, username: Column) -> Column:
    missing = (F.coalesce(platform, F.lit("")) == "") | (F.coalesce(username, F.lit("")) == "")
    return F.when(missing, "missing_parameters").when(~F.lower(platform).isin(SUPPORTED_SITES), "unsupported_platform")


def video_request_error(post_ids: Column, style: Column, seconds: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(post_ids), F.lit(0)) < 1, "posts_required")
        .when(~F.coalesce(style.isin(VIDEO_STYLES), F.lit(False)), "style_unknown")
        .when(~F.coalesce(seconds.between(30, 300), F.lit(False)), "duration_out_of_range")
    )
