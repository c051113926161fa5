"""Running means on a stream against a loop, over several batches and silences."""

import datetime as dt
import random
from collections import defaultdict
from fractions import Fraction

from siftline.streaming import requests
from siftline.streaming.latencies import running_means

AT = dt.datetime(2024, 1, 1)


def test_running_means_of_a_stream_against_a_loop(spark, tmp_path):
    rng, at, rows = random.Random(3), AT, []
    for k in range(500):
        at += dt.timedelta(seconds=rng.choice([0, 1, 60, 60, 4000]))
        rows.append((k, at, rng.randrange(3), rng.choice(["view", "error"]), None if k % 41 == 0 else round(rng.uniform(0, 50), 2), "{}"))
    quiet, want, last, values = dt.timedelta(hours=2), {}, {}, defaultdict(list)
    for event, ts, _, kind, value, _ in rows:
        if value is None:
            continue
        if kind in last and ts - last[kind] > quiet:
            values[kind].clear()
        last[kind] = ts
        values[kind].append(Fraction(str(value)))
        mine = values[kind][-20:]
        want[event] = (kind, len(mine), float(sum(mine) / len(mine)))
    for k in range(0, 500, 125):
        spark.createDataFrame(rows[k : k + 125], requests.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = running_means(requests.stream(spark, f"{tmp_path}/in"), "event_type", quiet, 20)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.unset(provider)
    got = {r["event_id"]: (r["key"], r["n"], r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in want)
    assert min(n for _, n, _ in got.values()) == 1 and max(n for _, n, _ in got.values()) == 20
