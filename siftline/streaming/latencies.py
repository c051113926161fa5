"""Means of the last requests of each key on a stream, with the requests' values as state that expires."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Values count in ten-thousandths, as whole numbers, so that sums are exact.
SCALE = 10_000
MEANS = "key string, event_id long, ts timestamp, n long, mean double"


class LastValues(StatefulProcessor):
    """The last values of a key, oldest first, and when the last one came; both go when nothing comes for a while."""

    def __init__(self, rows: int, quiet: timedelta):
        self.rows, self.quiet = rows, int(quiet.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "v long")
        self.last = handle.getValueState("last", "ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        values = deque((x[0] for x in self.values.get()) if self.values.exists() else ())
        last = self.last.get()[0] if self.last.exists() else None
        total, out = sum(values), []
        given = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for ts, event, value in zip(given["ts"], given["event_id"], given["value"], strict=True):
            ms = int(ts.value // 1_000_000)
            if last is not None and ms > last + self.quiet:
                values.clear()
                total = 0
            last = ms
            values.append(round(value * SCALE))
            total += values[-1]
            if len(values) > self.rows:
                total -= values.popleft()
            out.append((key[0], event, ts, len(values), total / SCALE / len(values)))
        self.values.put([(v,) for v in values])
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(last + self.quiet)
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "n", "mean"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.values.clear()
        self.last.clear()
        yield pd.DataFrame({"key": [], "event_id": [], "ts": [], "n": [], "mean": []}).astype({"key": "object", "event_id": "int64", "ts": "datetime64[ns]", "n": "int64"})


def running_means(events: DataFrame, key: str, quiet: timedelta, rows: int = 1000, late: str = "1 hour") -> DataFrame:
    """(key, event_id, ts, n, mean): of each event's value and those before it, ``rows`` at most, of its key.

    After a silence of more than ``quiet`` a key begins anew; its state is gone once the watermark, which is ``late`` behind, has passed
    that. Events without a value are left out. Wants the RocksDB state store.
    """
    given = events.filter("value is not null").select(F.col(key).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    watched = given.withWatermark("ts", late).groupBy("key")
    return watched.transformWithStateInPandas(LastValues(rows, quiet), MEANS, "append", "eventTime")
