"""Operators against sequential simulations, and streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import dedup, records, stats, store, windows
from siftline.sources import tables
from siftline.streaming import requests



def as_of():
    return F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")


AT = dt.datetime(2024, 1, 10)


def posts_of(spark, rows):
    return spark.createDataFrame(rows, "pos int, url string, title string, content string, published_at timestamp_ntz")


@pytest.mark.parametrize(
    ("scores", "kept"), [([0, 0, 0, 0, 1], [0, 1, 2, 4]), ([1, 1, 1, 0], [0, 1, 2]), ([1, 0, 1, 0, 0, 1], [0, 1, 2, 5]), ([0, 1, 1, 1], [0, 1, 2, 3])]
)
def test_keep_three(spark, scores, kept):
    rows = [(k, f"u{k}", "title", "the words of it" if s else "no words of it", None) for k, s in enumerate(scores)]
    got = dedup.relevant(posts_of(spark, rows), "the").collect()
    assert sorted(r["pos"] for r in got) == kept


def test_staged_and_greedy_differ(spark):
    rows = [(0, "u0", "h1"), (1, "u1", "h1"), (2, "u1", "h0")]
    df = spark.createDataFrame([(1, *r) for r in rows], "batch_id int, pos int, url string, content_hash string")
    assert sorted(r["pos"] for r in dedup.greedy(df).collect()) == [0, 2]
    by_url = dedup.keep_first(df, ["url"], ["pos"])
    assert sorted(r["pos"] for r in dedup.keep_first(by_url, ["content_hash"], ["pos"]).collect()) == [0]


def test_greedy_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(b, p, f"u{rng.randrange(6)}", f"h{rng.randrange(6)}") for b in range(40) for p in range(rng.randrange(1, 12))]
    want = set()
    for b in range(40):
        urls, hashes = set(), set()
        for _, p, u, h in [r for r in rows if r[0] == b]:
            if u not in urls and h not in hashes:
                urls.add(u)
                hashes.add(h)
                want.add((b, p))
    df = spark.createDataFrame(rows, "batch_id int, pos int, url string, content_hash string")
    assert {(r["batch_id"], r["pos"]) for r in dedup.greedy(df).collect()} == want


def test_saving_twice_adds_nothing(spark):
    batch = spark.createDataFrame(
        [(1, "h1", "u1", "weibo"), (2, "h1", "u2", "weibo"), (3, "h3", "u1", "weibo"), (4, "h4", "", "weibo"), (5, "h5", "", "weibo")],
        "pos int, content_hash string, url string, platform string",
    )
    new = dedup.new_contents(batch, batch.limit(0))
    assert sorted(r["pos"] for r in new.collect()) == [1, 4, 5]
    assert dedup.new_contents(batch, new).count() == 0
    assert dedup.violations(new, ["content_hash"]).count() == 0


def test_newest_first_with_undated_rows(spark):
    rows = [(0, "a", "t", "c", None), (1, "b", "t", "c", AT - dt.timedelta(days=400)), (2, "c", "t", "c", AT), (3, "d", "t", "c", AT)]
    assert [r["pos"] for r in dedup.newest(posts_of(spark, rows), as_of(), 3).collect()] == [2, 3, 0]


def test_time_defaults(spark):
    rows = [(0, "a", "t", "c", None), (1, "b", "t", "c", AT), (2, "c", "t", "c", None)]
    got = windows.dated(posts_of(spark, rows).withColumn("b", F.lit(1)), "published_at", as_of(), "pos", "b").orderBy("pos").collect()
    assert [r["published_at"] for r in got] == [AT - dt.timedelta(hours=1), AT, AT - dt.timedelta(hours=3)]


def events_of(spark, rng, n=400, users=7):
    rows = []
    for k in range(n):
        rows.append((k, AT + dt.timedelta(minutes=rng.randrange(3000)), rng.randrange(users), rng.choice(["error", "view"]), float(k % 13), "{}"))
    return rows, spark.createDataFrame(rows, requests.EVENTS)


def limiter(rows, rate, window):
    state, out = {}, {}
    for e, ts, user, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        s = state.get(user)
        if s is None:
            state[user], out[e] = [ts, 1, None], True
        elif s[2] is not None and ts < s[2]:
            out[e] = False
        elif ts - s[0] >= window:
            state[user], out[e] = [ts, 1, None], True
        else:
            s[1] += 1
            out[e] = s[1] <= rate
            if not out[e]:
                s[2] = ts + window
    return out


def test_rate_limit_against_a_loop(spark):
    rows, df = events_of(spark, random.Random(2))
    window = dt.timedelta(hours=2)
    got = {r["event_id"]: r["accepted"] for r in windows.rate_limited(df, "user_id", 3, window).collect()}
    assert got == limiter(rows, 3, window) and not all(got.values())


@pytest.mark.parametrize(("seed", "rate", "hours"), [(2, 3, 2), (3, 1, 1), (4, 20, 30), (5, 4, 200)])
def test_busy_clients_are_limited_alike(spark, seed, rate, hours):
    rows, df = events_of(spark, random.Random(seed))
    rows = [*rows, *((1000 + k, AT + dt.timedelta(minutes=k // 3), None, "view", 0.0, "") for k in range(60))]
    df = spark.createDataFrame(rows, requests.EVENTS).repartition(3)
    window = dt.timedelta(hours=hours)
    for most in (0, 55, 1000):  # all clients, those with more requests than some, none
        got = {r["event_id"]: r["accepted"] for r in windows.rate_limited(df, "user_id", rate, window, most).collect()}
        assert got == limiter(rows, rate, window) and not all(got.values())
    assert windows.limited_by_jumps(df.limit(0).select("user_id", "ts", "event_id"), "user_id", rate, window).collect() == []


def test_rate_limit_blocks_and_resets(spark):
    minutes = [0, 1, 2, 3, 64]
    rows = [(k, AT + dt.timedelta(minutes=m), 1, "view", 0.0, "") for k, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, requests.EVENTS)
    got = windows.rate_limited(df, "user_id", 3, dt.timedelta(hours=1)).orderBy("event_id").collect()
    assert [r["accepted"] for r in got] == [True, True, True, False, True]


def streamed(spark, df, path, make, mode="append"):
    df.orderBy("ts", "event_id").coalesce(1).write.parquet(path)
    name = "q" + str(abs(hash(path)))
    query = make(requests.stream(spark, path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    rows, df = events_of(spark, random.Random(3))
    window = dt.timedelta(hours=2)
    got = streamed(spark, df, f"{tmp_path}/a", lambda s: requests.limited(s, 3, window)).collect()
    assert {r["event_id"]: r["accepted"] for r in got} == limiter(rows, 3, window)
    changed = streamed(spark, df, f"{tmp_path}/b", requests.status_changes).collect()
    batch = windows.status_changes(df.withColumn("ok", F.col("event_type") != "error"), "user_id", ["ts", "event_id"], "ok")
    assert {r["event_id"] for r in changed} == {r["event_id"] for r in batch.collect()}
    counted = streamed(spark, df, f"{tmp_path}/c", lambda s: requests.tumbling(s, "1 hour"), "complete")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, requests.tumbling(df, "1 hour").collect()))
    runs = streamed(spark, df, f"{tmp_path}/d", lambda s: requests.sessions(s, "30 minutes"), "complete")
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, requests.sessions(df, "30 minutes").collect()))


def test_alerts_and_sliding_windows(spark):
    _, df = events_of(spark, random.Random(4))
    assert requests.sliding(df, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * df.count()
    assert requests.distinct_events(df.union(df)).count() == df.count()
    metrics = spark.createDataFrame([("cpu", 0.9), ("free", 0.1), ("ok", 0.5)], "metric string, value double")
    rules = spark.createDataFrame([("cpu", "greater_than", 0.8, "high"), ("free", "less_than", 0.2, "low"), ("ok", "greater_than", 0.6, "low")], "metric string, comparison string, threshold double, severity string")
    assert sorted(r["metric"] for r in requests.alerts(metrics, rules).collect()) == ["cpu", "free"]


@pytest.mark.parametrize("block", [7, 1000])
def test_moving_mean_against_a_loop(spark, block):
    rng = random.Random(5)
    rows = [(k, rng.randrange(1000)) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(5)
    got = [r["mean"] for r in windows.moving_mean(df, "v", ["k"], 5, block).orderBy("k").collect()]
    want = [sum(v for _, v in rows[max(0, k - 4) : k + 1]) / min(5, k + 1) for k in range(60)]
    assert got == pytest.approx(want)


def test_due_and_valid(spark):
    rows = [(1, True, None, None), (2, True, "idle", AT), (3, True, "crawling", AT), (4, False, "idle", AT), (5, True, "idle", AT + dt.timedelta(1))]
    df = spark.createDataFrame(rows, "id int, auto boolean, status string, next_at timestamp_ntz")
    due = df.filter(store.is_due(F.col("auto"), F.col("status"), F.col("next_at"), as_of()))
    assert sorted(r["id"] for r in due.collect()) == [1, 2]
    rows = [(1, True, AT), (2, True, None), (3, False, None), (4, True, AT - dt.timedelta(1)), (5, True, AT + dt.timedelta(1))]
    df = spark.createDataFrame(rows, "id int, active boolean, expires timestamp_ntz")
    one = lambda f: sorted(r["id"] for r in df.filter(f(F.col("active"), F.col("expires"), as_of())).collect())
    assert one(store.is_valid_session) == [1, 2, 5]
    assert one(store.is_active_session) == [5]


def test_selection_guards_against_everything(spark):
    df = spark.createDataFrame([("a" * 24, "weibo"), ("b" * 24, "douyin")], "id string, platform string")
    assert store.selected(df, []).count() == 0
    assert store.selected(df, [], allow_all=True).count() == 2
    assert store.selected(df, [], platform="weibo").count() == 1
    assert store.selected(df, ["a" * 24, "no id"]).count() == 1


def test_search_before_and_after_the_limit(spark):
    rows = [(k, "weibo", "c", f"title {k}", "text" if k else None, AT + dt.timedelta(minutes=k)) for k in range(5)]
    df = spark.createDataFrame(rows, "id int, platform string, creator_id string, title string, content string, created_at timestamp_ntz")
    assert store.searched(df, "TITLE 0").count() == 1
    assert store.searched(df, "title 0", recent=3).count() == 0
    assert store.searched(df, "", platform="douyin").count() == 0


def test_updates_keep_or_clear(spark):
    old = spark.createDataFrame([(1, "a", "e"), (2, "b", "f")], "id int, status string, error string")
    new = spark.createDataFrame([(1, "c", "")], "id int, status string, error string")
    kept = {r["id"]: (r["status"], r["error"]) for r in store.updated(old, new, "id", ["status", "error"]).collect()}
    assert kept == {1: ("c", "e"), 2: ("b", "f")}
    cleared = {r["id"]: r["error"] for r in store.updated(old, new, "id", ["error"], clear_empty=True).collect()}
    assert cleared == {1: None, 2: "f"}


def test_task_events(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    events = spark.createDataFrame(
        [(1, 1, "running", "", AT), (1, 2, "failed", "boom", AT + dt.timedelta(1)), (1, 3, "failed", "", AT + dt.timedelta(2))],
        "task_id int, seq int, status string, error string, at timestamp_ntz",
    )
    one, two = store.with_status(tasks, events).orderBy("task_id").collect()
    assert (one["status"], one["error"], one["started_at"], one["completed_at"]) == ("failed", "boom", AT, AT + dt.timedelta(2))
    assert two["status"] == "pending"


def test_after_crawls(spark):
    creators = spark.createDataFrame([(1, 60, "crawling", AT, None), (2, 60, "crawling", AT, None), (3, 60, "idle", AT, "old")], "id int, crawl_interval int, crawl_status string, next_crawl_at timestamp_ntz, crawl_error string")
    results = spark.createDataFrame([(1, ""), (2, "boom")], "id int, error string")
    got = [tuple(r)[2:] for r in store.after_crawls(creators, results, as_of()).orderBy("id").collect()]
    assert got == [("idle", AT + dt.timedelta(hours=1), None), ("failed", AT, "boom"), ("idle", AT, "old")]


def test_publish_outcomes(spark):
    rows = [(1, True, ""), (1, True, ""), (2, True, ""), (2, False, "b"), (2, False, "a"), (3, False, "x")]
    df = spark.createDataFrame(rows, "task int, ok boolean, message string")
    tasks = spark.createDataFrame([(k,) for k in range(1, 5)], "task int")
    got = {r["task"]: (r["outcome"], r["errors"]) for r in stats.publish_outcome(df, tasks, "task", "ok", "message").collect()}
    assert got == {1: ("published", []), 2: ("partial", ["a", "b"]), 3: ("failed", ["x"]), 4: ("published", [])}


def test_validators(spark):
    rows = [("v", ["youtube"], "d"), ("", ["youtube"], "d"), ("v", [], "d"), ("v", ["x"], "d"), ("v", ["youtube"], "  ")]
    df = spark.createDataFrame(rows, "v string, p array<string>, d string")
    got = [r[0] for r in df.select(store.publish_errors(F.col("v"), F.col("p"), F.col("d"), ["youtube"])).collect()]
    assert got == [None, "video_required", "platform_required", "platform_unsupported", "description_required"]
    df = spark.createDataFrame([("bob", "a@b.c", "abc123", "abc123"), ("b", "a", "abc", "x")], "n string, e string, p string, q string")
    got = [r[0] for r in df.select(store.registration_errors(*map(F.col, "nepq"))).collect()]
    assert got == [{}, {"username": "too_short", "email": "malformed", "password": "too_weak", "confirm": "differs"}]
    df = spark.createDataFrame([("image/png", "abc-_9"), ("video/mp4", "x"), (None, None)], "m string, i string")
    got = [tuple(r) for r in df.select(records.is_image(F.col("m")), records.is_video(F.col("m")), records.is_video_id(F.col("i"))).collect()]
    assert got == [(True, False, True), (False, True, False), (False, False, False)]


def test_eviction(spark):
    rows = [(k, "a" if k < 6 else "b", k) for k in range(9)]
    df = spark.createDataFrame(rows, "id int, platform string, at int")
    assert sorted(r["id"] for r in windows.evicted(df, "platform", ["at"]).collect()) == [0, 1]


def test_backup_and_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, AT, "x"), (2, None, None)], "id int, created_at timestamp_ntz, name string")
    tables.backed_up(df, f"{tmp_path}/b")
    assert sorted(map(tuple, tables.restored(spark, f"{tmp_path}/b", df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_files_by_content(spark, tmp_path):
    for name, data in (("a.txt", b"1"), ("b.txt", b"1"), ("c.png", b"2")):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    known = spark.createDataFrame([], "hash string")
    keys = [r["key"] for r in tables.by_content_hash(files, known, "media", 7).collect()]
    assert len(keys) == 2 and all(k.startswith("media/") and "_7." in k for k in keys)
    again = tables.by_content_hash(files, tables.by_content_hash(files, known, "m", 1).select("hash"), "m", 1)
    assert again.count() == 0
    assert tables.objects(spark, str(tmp_path)).count() == 3
    assert tables.with_prefix(tables.objects(spark, str(tmp_path)), f"file:{tmp_path}/a", -1).count() == 1


def test_replies_of_all_shapes(spark):
    rows = [('{"posts": [{"t": "a"}]}',), ('{"data": [{"t": "b"}]}',), ('{"total": 2, "t": "c"}',), ("{}",)]
    got = spark.createDataFrame(rows, "body string").select(tables.response_posts(F.col("body"), "struct<t:string>").alias("p")).collect()
    assert [[x["t"] for x in r["p"]] if r["p"] is not None else None for r in got] == [["a"], ["b"], ["c"], None]


def test_settings_and_logs(spark, tmp_path):
    assert tables.settings(f"{tmp_path}/none.json", {"a": 1}) == {"a": 1}
    (tmp_path / "s.json").write_text('{"a": 2}')
    assert tables.settings(f"{tmp_path}/s.json", {"a": 1, "b": 0}) == {"a": 2, "b": 0}
    rows, df = events_of(spark, random.Random(6), 20)
    tables.access_log(df, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 20
    seed = spark.createDataFrame([(1,)], "k int")
    assert tables.seeded(seed.limit(0), seed).count() == 1
    assert tables.with_task_defaults(spark.createDataFrame([(0,), (5,)], "limit int")).orderBy("limit").first()["limit"] == 5


def test_upserts_and_unions(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, updated_at int, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, None, "e")], "k int, updated_at int, v string")
    assert {r["k"]: r["v"] for r in tables.upserted(old, new, ["k"]).collect()} == {1: "c", 2: "b", 3: "e"}
    sources = [spark.createDataFrame([(k, s) for k in range(4)], "pos int, s string") for s in "ab"]
    got = records.first_of_sources(sources, 5, prefix=3).collect()
    assert [(r["s"], r["pos"]) for r in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
