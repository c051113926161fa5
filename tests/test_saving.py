"""Saves that happen once, changes that touch their buckets alone, and greedy duplicates of one large batch."""

import os
import random

import pytest

from siftline.operators import dedup
from siftline.sources.buckets import Bucketed
from siftline.streaming.saves import History

CONTENT = "pos long, content_hash string, url string, platform string, body string"


def files_of(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def made_contents(n=400, seed=2):
    rng = random.Random(seed)
    rows = [(k, rng.choice([f"{rng.randrange(90):032x}"[::-1], None, f"{rng.randrange(90):x}x"]), rng.choice(["", None, f"u{rng.randrange(150)}"]), rng.choice("ab"), "b" * (k % 5)) for k in range(n)]
    return rows


def plain_saves(batches):
    """Ids by one loop over batches; within a batch hashes come first, then addresses, as in ``new_contents``."""
    hashes, addresses, kept = set(), set(), []
    for rows in batches:
        fresh = [r for r in rows if r[1] not in hashes and (not r[2] or (r[2], r[3]) not in addresses)]
        once, seen = [], set()
        for r in fresh:
            if r[1] is None or r[1] not in seen:
                once.append(r)
                seen.add(r[1])
        places = set()
        for r in once:
            if not r[2] or (r[2], r[3]) not in places:
                places.add((r[2], r[3]))
                kept.append(r[0])
                hashes |= {r[1]} - {None}
                addresses |= {(r[2], r[3])} if r[2] else set()
    return sorted(kept)


def test_a_stream_that_is_stopped_and_taken_up_saves_each_once(spark, tmp_path):
    rows = made_contents()
    batches = [rows[k : k + 100] for k in range(0, 400, 100)]
    frames = [spark.createDataFrame(b, CONTENT).coalesce(1) for b in batches]
    history = History(f"{tmp_path}/history", frames[0].schema, 1)
    failing = []

    class Failing(History):
        def _write(self, rows, name, batch_id):
            super()._write(rows, name, batch_id)
            if batch_id == 1 and name == "contents" and not failing:
                failing.append(1)
                raise OSError("lost between contents and addresses")

    def run(kind):
        source = spark.readStream.schema(CONTENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        kind(f"{tmp_path}/history", history.schema, 1).start(source, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()

    for frame in frames[:3]:
        frame.write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="lost between"):
        run(Failing)
    assert failing and {r["batch_id"] for r in history.rows(spark).collect()} == {0, 1}
    run(History)
    frames[3].write.mode("append").parquet(f"{tmp_path}/in")
    run(History)
    saved = history.rows(spark).collect()
    in_order = {}
    for r in saved:
        in_order.setdefault(r["batch_id"], []).append(r["pos"])
    assert sorted(r["pos"] for r in saved) == plain_saves(batches)
    assert [sorted(in_order[k]) for k in sorted(in_order)] == [[p for p in plain_saves(batches) if p // 100 == k] for k in range(4)]
    before = files_of(f"{tmp_path}/history")
    history.save(frames[3], 3)
    assert sorted(r["pos"] for r in history.rows(spark).collect()) == plain_saves(batches)
    changed = {f for f in files_of(f"{tmp_path}/history") if before.get(f) is None}
    assert changed and all("batch_id=3" in f for f in changed)


def test_a_batch_reads_only_the_folders_of_its_prefixes(spark, tmp_path):
    rows = spark.createDataFrame(made_contents(), CONTENT)
    history = History(f"{tmp_path}/history", rows.schema, 1)
    history.save(rows, 0)
    one = rows.filter("content_hash like '1%'").select(history._prefix(rows["content_hash"]))
    near = history._near(spark, "contents", history.schema, one, 7)
    assert {f.split("prefix=")[1][:2] for f in near.inputFiles()} >= {"p1"} and "PartitionFilters: [" in near._jdf.queryExecution().toString()
    assert {r["content_hash"][0] for r in near.collect()} == {"1"}


@pytest.fixture
def customers(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('n', id) name", "0L at")
    kept = Bucketed(f"{tmp_path}/t", ("id",), 16, df.schema)
    kept.create(df)
    return kept


def test_changes_rewrite_only_their_buckets(spark, customers):
    def changed(change):
        before = files_of(customers.path)
        touched = change()
        after = files_of(customers.path)
        moved = {f.split("bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()} | {f.split("bucket=")[1].split("/")[0] for f in before.keys() & after.keys() if before[f] != after[f]}
        assert moved == set(map(str, touched)) and len(touched) < 5
        return {r["id"]: (r["name"], r["at"]) for r in customers.rows(spark).collect()}

    want = {k: (f"n{k}", 0) for k in range(1000)}
    found = changed(lambda: customers.upsert(spark.createDataFrame([(5, "old", -1), (6, "new", 2), (5000, "more", 1), (6, "newer", 3)], customers.schema), "at"))
    want |= {6: ("newer", 3), 5000: ("more", 1)}
    assert found == want
    found = changed(lambda: customers.update(spark.createDataFrame([(7, "x", 1), (7, "y", 2), (8, "", 1), (99999, "z", 1)], "id long, name string, k long"), ["name"], order="k"))
    want[7] = ("y", 0)
    assert found == want
    found = changed(lambda: customers.delete(spark.createDataFrame([(7,), (8,), (7,)], "id long")))
    del want[7], want[8]
    assert found == want
    assert customers.upsert(spark.createDataFrame([], customers.schema), "at") == []


def test_buckets_that_are_emptied(spark, customers):
    bucket = customers.bucket()
    customers.delete(customers.rows(spark).filter(bucket == 3).select("id"))
    assert customers.rows(spark).filter(bucket == 3).count() == 0
    assert customers.rows(spark).count() == spark.range(1000).filter(bucket != 3).count()
    customers.delete(customers.rows(spark).select("id"))
    assert customers.rows(spark).count() == 0


def test_a_change_may_not_move_a_row(spark, customers):
    with pytest.raises(Exception, match="may not alter keys"):
        customers._change(spark.createDataFrame([(1,)], "id long"), lambda old, _: old.selectExpr("id + 1 id", "name", "at"))


def loop(rows):
    seen, kept = {}, set()
    for b, p, u, h in sorted(rows, key=lambda r: r[1]):
        urls, hashes = seen.setdefault(b, (set(), set()))
        if u not in urls and h not in hashes:
            urls.add(u)
            hashes.add(h)
            kept.add((b, p))
    return kept


def test_greedy_of_a_large_batch_equals_the_loop(spark):
    rng = random.Random(7)
    rows = [(0, p, rng.choice([None, "hot", f"u{rng.randrange(40_000)}"]), f"h{rng.randrange(60_000)}" if p % 3 else "hot") for p in range(100_000)]
    df = spark.createDataFrame(rows, "batch_id int, pos long, url string, content_hash string").repartition(8)
    assert {(r["batch_id"], r["pos"]) for r in dedup.greedy(df).collect()} == loop(rows)


def test_greedy_of_chains_repeats_and_nothing(spark):
    kind = "batch_id int, pos long, url string, content_hash string, body string"
    rows = [(None, k, f"u{k // 2}", f"h{(k + 1) // 2}") for k in range(12)] + [(1, 0, None, None), (1, 1, None, "x"), (1, 2, "a", "x")]
    assert {(r["batch_id"], r["pos"]) for r in dedup.greedy(spark.createDataFrame([(*r, "b") for r in rows], kind)).collect()} == loop(rows)
    assert len(dedup.greedy(spark.createDataFrame([(1, 0, "a", "b", "x")] * 5, kind)).collect()) == 1
    assert dedup.greedy(spark.createDataFrame([], kind)).collect() == []
