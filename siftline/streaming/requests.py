"""Request streams: windowed metrics, sessions by gaps, rate limits, status changes, alerts.

Each function takes a batch or a streaming DataFrame of events (event_id, ts, user_id, event_type, value).
Watermarks need timestamps with a zone, so times are cast where they come without; the session's zone is UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return zoned.withWatermark("ts", late) if events.isStreaming else zoned


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """By window and event type: how many and their value."""
    found = _watermarked(events, late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    found = _watermarked(events, late).groupBy(F.window("ts", width, step)).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "errors")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """By user: runs of events less than ``gap`` apart."""
    found = _watermarked(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once by id; repeats later than the watermark allows come through."""
    marked = _watermarked(events, late)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics that break a threshold rule; Spark sees from their size whether rules are broadcast. Columns: metric, value; metric, comparison, threshold, severity."""
    joined = metrics.join(rules, "metric")
    over = (F.col("comparison") == "greater_than") & (F.col("value") > F.col("threshold"))
    under = (F.col("comparison") == "less_than") & (F.col("value") < F.col("threshold"))
    return joined.filter(over | under)


def limited(events: DataFrame, rate: int, window: timedelta) -> DataFrame:
    """The rate limiter on a stream: (user_id, event_id, accepted), with a client's start, count and block as state.

    Within a micro-batch a client's events are taken in order of time and id; order across batches is arrival.
    """
    micros = int(window.total_seconds() * 1_000_000)

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, until = state.get if state.exists else (None, 0, None)
        frame = pd.concat(frames).sort_values(["ts", "event_id"])
        accepted = []
        for ts in frame["ts"].astype("datetime64[us]").astype("int64"):
            ts = int(ts)
            if start is None:
                start, n, ok = ts, 1, True
            elif until is not None and ts < until:
                ok = False
            elif ts - start >= micros:
                start, n, until, ok = ts, 1, None, True
            else:
                n += 1
                ok = n <= rate
                if not ok:
                    until = ts + micros
            accepted.append(ok)
        state.update((start, n, until))
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"].to_numpy(), "accepted": accepted})

    return events.groupBy("user_id").applyInPandasWithState(
        scan, "user_id long, event_id long, accepted boolean", "start long, n long, until long", "append", GroupStateTimeout.NoTimeout
    )


def status_changes(events: DataFrame) -> DataFrame:
    """(user_id, event_id, ok): events whose outcome differs from the client's last one, which is the state."""

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else False
        frame = pd.concat(frames).sort_values(["ts", "event_id"])
        ok = (frame["event_type"] != "error").to_numpy()
        changed = [x != y for x, y in zip(ok, [before, *ok[:-1]], strict=True)]
        if len(ok):
            state.update((bool(ok[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"].to_numpy(), "ok": ok})[changed]

    return events.groupBy("user_id").applyInPandasWithState(
        scan, "user_id long, event_id long, ok boolean", "ok boolean", "append", GroupStateTimeout.NoTimeout
    )
