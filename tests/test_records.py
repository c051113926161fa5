"""Nested documents as texts, restores, counts of changes, deletes and searches on literal rows."""

from datetime import datetime

from pyspark.sql import functions as F

from siftline.operators import stats, store
from siftline.sources import tables


def test_times_and_ids_become_texts_at_any_depth(spark):
    at, whole = datetime(2024, 1, 2, 3, 4, 5, 60), datetime(2024, 1, 2)
    schema = "id binary, n int, d struct<at: timestamp_ntz, deep: array<struct<at: timestamp, x: double>>>, m map<string, array<timestamp_ntz>>, `odd.name` timestamp_ntz"
    rows = [(b"\x01\xab", 1, (at, [(whole, 1.5), (None, None), None]), {"a": [at, None], "b": None}, whole), (None, None, None, None, None)]
    found = [r.asDict(recursive=True) for r in store.texted(spark.createDataFrame(rows, schema)).collect()]
    assert found[0] == {
        "id": "01ab",
        "n": 1,
        "d": {"at": "2024-01-02T03:04:05.000060", "deep": [{"at": "2024-01-02T00:00:00", "x": 1.5}, {"at": None, "x": None}, None]},
        "m": {"a": ["2024-01-02T03:04:05.000060", None], "b": None},
        "odd.name": "2024-01-02T00:00:00",
    }
    assert set(found[1].values()) == {None}
    assert store.texted(spark.createDataFrame([], schema)).count() == 0


def test_a_restore_keeps_what_is_no_time_and_may_clear_first(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, made_at timestamp_ntz, run struct<endedAt: timestamp_ntz, note: string>").schema
    text = "id int, made_at string, run struct<endedAt: string, note: string>"
    rows = [(1, "2024-01-02T03:04:05", ("never", "a")), (2, "soon", ("2024-01-02T03:04:05", "b")), (3, None, None)]
    tables.backed_up(spark.createDataFrame(rows, text), f"{tmp_path}/backup")
    found = {r["id"]: r for r in tables.restored(spark, f"{tmp_path}/backup", schema).collect()}
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert (found[1]["made_at"], found[1]["run"]["endedAt"], found[1]["run"]["note"]) == (at, None, "a")
    assert (found[2]["made_at"], found[2]["run"]["endedAt"], found[3]["run"]) == (None, at, None)
    bad = tables.bad_times(spark, f"{tmp_path}/backup", schema, ["id"])
    assert sorted(map(tuple, bad.collect())) == [(1, "run.endedAt", "never"), (2, "made_at", "soon")]
    for clear, n in ((False, 3), (False, 6), (True, 3)):
        tables.restored_into(spark, f"{tmp_path}/backup", f"{tmp_path}/table", schema, clear)
        assert spark.read.parquet(f"{tmp_path}/table").count() == n


def test_matched_and_modified_rows(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "id int, s string, n int")
    after = before.withColumn("n", F.when(F.col("id") == 2, 5).otherwise(F.col("n"))).filter("id < 3")
    assert tuple(store.modified(before, after, ["id"]).first()) == (2, 1)
    assert tuple(store.modified(before.limit(0), after, ["id"]).first()) == (0, 0)


def test_deletes_of_owned_rows_and_instances(spark):
    rows = spark.createDataFrame([(1, 7, "i", "weibo"), (2, 7, "i", "news"), (3, 8, None, None), (None, None, "j", "weibo")], "id int, user_id int, instance_id string, platform string")

    def ids(df):
        return sorted((r["id"] or 0) for r in df.collect())

    assert ids(store.without_owned(rows, 1, 7)) == [0, 2, 3]
    assert ids(store.without_owned(rows, 1, 8)) == [0, 1, 2, 3]
    assert ids(store.without_instance(rows, "i")) == [0, 3]
    assert ids(store.without_instance(rows, "i", "weibo")) == [0, 2, 3]


def test_searches_of_videos_and_items(spark):
    videos = spark.createDataFrame([(1, "Cat video", "done", "a"), (2, "dog", "done", "b"), (3, None, "open", "a")], "id int, title string, status string, creator_id string")
    assert [r["id"] for r in store.searched_videos(videos, "CAT").collect()] == [1]
    assert [r["id"] for r in store.searched_videos(videos, "", "done", "b").collect()] == [2]
    assert store.searched_videos(videos).count() == 3
    items = spark.createDataFrame([(1, "x", "a Tool", "plugin"), (2, "tool", None, "theme")], "id int, name string, description string, category string")
    assert sorted(r["id"] for r in store.searched_items(items, "tool").collect()) == [1, 2]
    assert [r["id"] for r in store.searched_items(items, "tool", "theme").collect()] == [2]


def test_overviews_by_range(spark):
    at = F.lit("2024-01-31").cast("timestamp_ntz")
    rows = [("w", datetime(2024, 1, 30, 12), 10, 5, 2), ("w", datetime(2024, 1, 29, 12), 4, 1, 1), ("b", datetime(2024, 1, 31), 1, 1, 1), ("w", datetime(2024, 2, 1), 99, 99, 99), ("w", None, 1, 1, 1)]
    posts = spark.createDataFrame(rows, "platform string, at timestamp_ntz, views long, engagement long, revenue long")
    found = {(r["days"], r["platform"]): r for r in stats.overviews(posts, at, (1, 7)).collect()}
    day = found[1, "w"]
    assert (day["posts"], day["views"], day["engagement_rate"], day["posts_growth"], day["views_growth"], day["revenue_growth"]) == (1, 10, 50.0, 0.0, 150.0, 100.0)
    assert (found[7, "w"]["posts"], found[7, "w"]["views_growth"], found[1, None]["posts"], found[7, None]["views"]) == (2, None, 2, 15)
    assert stats.overviews(posts.limit(0), at).count() == 0
