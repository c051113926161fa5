"""Statistics of stored tables: one scan each, whatever the number of figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import vocabulary as V
from siftline.functions.urls import has_any

from .store import is_active_session, is_unread


def session_stats(sessions: DataFrame, as_of: Column) -> DataFrame:
    """By platform and in total (platform null): sessions, active and logged-in ones."""
    active = is_active_session(F.col("is_active"), F.col("expires_at"), as_of)
    return sessions.rollup("platform").agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(F.coalesce("is_logged_in", F.lit(False))).alias("logged_in"),
    )


def latest_by_platform(cookies: DataFrame) -> DataFrame:
    return cookies.groupBy("platform").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))


def by_status_and_platform(tasks: DataFrame) -> DataFrame:
    """Counts by status, by platform and in all; level: 1 by status, 2 by platform, 3 in all."""
    grouped = tasks.groupingSets([["status"], ["platform"], []], "status", "platform")
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def request_metrics(requests: DataFrame, last: int = 1000) -> DataFrame:
    """All requests, failed ones, and the mean latency of the last ones (0 without any)."""
    tail = requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(last).agg(F.avg("value").alias("mean_latency"))
    totals = requests.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return totals.crossJoin(tail).withColumn("mean_latency", F.round(F.coalesce("mean_latency", F.lit(0.0)), 4))


def publish_outcome(results: DataFrame, tasks: DataFrame, task: str, ok: str, message: str) -> DataFrame:
    """By task: published without errors (also without any platform), partial with some, failed with nothing else; with the errors."""
    errors = F.array_sort(F.collect_list(F.when(~F.col(ok), F.col(message))))  # a task has a platform once: few
    found = results.groupBy(task).agg(
        F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"), errors.alias("errors")
    )
    none = {"succeeded": F.lit(0), "failed": F.lit(0), "errors": F.array().cast("array<string>")}
    counted = tasks.select(task).join(found, task, "left").withColumns({k: F.coalesce(k, v) for k, v in none.items()})
    outcome = F.when(F.col("failed") == 0, "published").when(F.col("succeeded") > 0, "partial").otherwise("failed")
    return counted.withColumn("outcome", outcome)


def overview(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    """By event type: how many and their value in the last ``days`` days, and the change from those before, in percent."""
    span = F.make_dt_interval(days=F.lit(days))
    now = (events["ts"] > as_of - span) & (events["ts"] <= as_of)
    before = (events["ts"] > as_of - span - span) & (events["ts"] <= as_of - span)
    found = events.filter(now | before).groupBy("event_type").agg(
        F.count_if(now).alias("n"), F.count_if(before).alias("n_before"), F.round(F.sum(F.when(now, F.col("value"))), 4).alias("value")
    )
    growth = F.when(F.col("n_before") > 0, F.round((F.col("n") - F.col("n_before")) * 100.0 / F.col("n_before"), 4))
    return found.withColumn("growth", growth)


def overviews(posts: DataFrame, as_of: Column, ranges: tuple[int, ...] = (1, 7, 30, 90)) -> DataFrame:
    """By range of days and platform, and over all platforms (null): posts, views, engagement, revenue, and their growth in percent.

    Growth is against the range of equal length before; null where that has none. A post is sent once into each range
    that it belongs to, summed before the shuffle. Columns: platform, at, views, engagement, revenue (exact numbers).
    """
    age = F.timestamp_diff("SECOND", F.col("at"), as_of)
    spread = posts.filter((age >= 0) & (age < 2 * max(ranges) * 86_400)).withColumn("days", F.explode(F.array(*map(F.lit, ranges))))
    spread = spread.filter(age < 2 * F.col("days") * 86_400)
    now = age < F.col("days") * 86_400
    sums = {"views": "views", "engagement": "engagement", "revenue": "revenue"}
    found = spread.groupingSets([["days", "platform"], ["days"]], "days", "platform").agg(
        F.count_if(now).alias("posts"), F.count_if(~now).alias("posts_before"),
        *(F.coalesce(F.sum(F.when(now, F.col(c))), F.lit(0)).alias(n) for n, c in sums.items()),
        *(F.sum(F.when(~now, F.col(c))).alias(f"{n}_before") for n, c in sums.items()),
    )

    def growth(name: str) -> Column:
        new, old = F.col(name).cast("double"), F.nullif(F.col(f"{name}_before").cast("double"), F.lit(0.0))
        return F.round((new - old) * 100 / old, 4).alias(f"{name}_growth")

    rate = F.round(F.col("engagement").cast("double") * 100 / F.nullif(F.col("views").cast("double"), F.lit(0.0)), 4)
    return found.select(
        "days", "platform", "posts", "views", "engagement", "revenue", rate.alias("engagement_rate"),
        *(growth(n) for n in ("posts", "views", "engagement", "revenue")),
    )


def database_status(tables: dict[str, DataFrame], creators: DataFrame, key: str, name: str, first: int = 3) -> DataFrame:
    """The number of rows of each table, then the first creators by their key."""
    counts = table_counts(tables).select(F.lit("count").alias("kind"), "name", F.col("n").alias("value"))
    some = creators.orderBy(key).limit(first).select(F.lit("creator").alias("kind"), F.col(name).alias("name"), F.col(key).cast("long").alias("value"))
    return counts.union(some)


def _held(c: Column, parts: list[str]) -> Column:
    return has_any(F.lower(c), parts)


def request_flags(requests: DataFrame) -> DataFrame:
    """Requests with what they are: failed, scripted, api, image, script, suspicious, slow, and signs of their platform.

    Columns: platform, resource_type, method, url, status_code, response_time and any others.
    """
    kind, url = F.lower("resource_type"), F.col("url")
    scripted = kind.isin("fetch", "xhr") | F.upper("method").isin("POST", "PUT", "PATCH")
    weibo, bilibili = F.col("platform") == "weibo", F.col("platform") == "bilibili"
    flags = {
        "failed": F.col("status_code") >= 400,
        "xhr": scripted,
        "api": scripted & _held(url, V.API_PARTS),
        "images": ~scripted & kind.isin("image", "imageset"),
        "scripts": ~scripted & kind.isin("script", "javascript"),
        "suspicious": _held(url, V.SUSPICIOUS_PARTS),
        "slow": F.col("response_time") > 5000,
        "weibo_api": weibo & _held(url, ["weibo.com/ajax", "weibo.com/api"]),
        "logins": weibo & _held(url, ["login", "passport"]),
        "rate_limited": weibo & ((F.col("status_code") == 429) | _held(url, ["rate limit"])),
        "video_api": bilibili & _held(url, ["bilibili.com/x/web-interface/view"]),
        "user_api": bilibili & _held(url, ["bilibili.com/x/space", "bilibili.com/x/relation"]),
        "cdn": bilibili & _held(url, ["hdslb.com", "bilivideo.com"]),
    }
    return requests.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


FLAGS = ["failed", "xhr", "api", "images", "scripts", "suspicious", "slow", "weibo_api", "logins", "rate_limited", "video_api", "user_api", "cdn"]


def network_summary(requests: DataFrame, messages: DataFrame, page: str) -> DataFrame:
    """By page: requests in all and by flag, console errors and warnings, and errors that tell of a block.

    The requests behind a number are rows of ``request_flags``; they aren't gathered in one row a page.
    Columns of messages: page, type, text.
    """
    counted = request_flags(requests).groupBy(page).agg(F.count("*").alias("total"), *(F.count_if(F.col(f)).alias(f) for f in FLAGS))
    kind = F.lower("type")
    console = messages.groupBy(page).agg(
        F.count_if(kind == "error").alias("console_errors"),
        F.count_if(kind == "warning").alias("console_warnings"),
        F.count_if((kind == "error") & _held(F.col("text"), V.BLOCKED_MESSAGES)).alias("blocked"),
    )
    joined = counted.join(console, page, "full")
    return joined.na.fill(0, [x for x in joined.columns if x != page])


def network_advice(summary: DataFrame) -> DataFrame:
    """What a summary calls for: labels in fixed order."""
    advice = F.array(
        F.when(F.col("failed") > F.col("total") * 0.3, "many_failures"),
        F.when(F.col("suspicious") > 0, "suspicious_requests"),
        F.when(F.col("slow") > 0, "slow_requests"),
        F.when(F.col("console_errors") > 5, "console_errors"),
        F.when(F.col("blocked") > 0, "blocked"),
        F.when(F.col("rate_limited") > 0, "rate_limited"),
    )
    return summary.withColumn("advice", F.filter(advice, lambda x: x.isNotNull()))


def scheduler_cards(tasks: DataFrame) -> DataFrame:
    """One row: tasks, running ones, their runs that succeeded and failed, and the mean of their mean durations."""
    return tasks.agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.coalesce(F.sum("successful_runs"), F.lit(0)).alias("succeeded"),
        F.coalesce(F.sum("failed_runs"), F.lit(0)).alias("failed"),
        F.round(F.avg("average_duration"), 4).alias("mean_duration"),
    )


def workflow_cards(workflows: DataFrame) -> DataFrame:
    """One row: active workflows, their executions and the time saved, where a missing number counts as none."""
    total = {name: F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("execution_count", "time_saved")}
    return workflows.agg(F.count_if(F.col("status") == "active").alias("active"), *total.values())


def integration_cards(integrations: DataFrame) -> DataFrame:
    """One row: how many categories, and integrations that are connected."""
    return integrations.agg(F.count_distinct("category").alias("categories"), F.count_if(F.col("status") == "connected").alias("connected"))


def alert_cards(alerts: DataFrame) -> DataFrame:
    """One row: alerts that are active, critical and active, and unread."""
    active = F.col("status") == "active"
    return alerts.agg(
        F.count_if(active).alias("active"),
        F.count_if(active & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(is_unread(F.col("read"))).alias("unread"),
    )


def platform_overview(posts: DataFrame) -> DataFrame:
    """By platform: posts, views, engagement per view in percent, and the share that succeeded. Columns: platform, views, engaged, ok."""
    return posts.groupBy("platform").agg(
        F.count("*").alias("posts"),
        F.sum("views").alias("views"),
        F.round(F.sum("engaged") * 100.0 / F.nullif(F.sum("views"), F.lit(0)), 4).alias("engagement_rate"),
        F.round(F.count_if(F.col("ok")) * 100.0 / F.count("*"), 4).alias("success_rate"),
    )
