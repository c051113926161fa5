"""What grows with the table is never broadcast by a guess of its size, however small the table of a test is."""

import random

import pytest

import corpus_pipeline as P
from siftline.llm import components, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_shuffled(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(63) for _ in range(50)]
    values = sorted({*values, *(v ^ 5 for v in values)})
    found = simhash.links(simhash.stored(spark.createDataFrame([(v,) for v in values], "bits long"), "bits"))
    assert "Broadcast" not in plan(found)
    assert "SortMergeJoin" in plan(found)
    assert found.count() == 50


@pytest.mark.parametrize("most", [simhash.BROADCAST_KEYS, 0])
def test_frequent_keys_are_broadcast_by_their_number(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "HOT_KEY", 1)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", most)
    found = simhash.links(spark.createDataFrame([(v,) for v in range(8)], "bits long"))
    assert ("Broadcast" in plan(found)) == (most > 0)
    assert found.count() == 28


@pytest.mark.parametrize("most", [simhash.BROADCAST_LINKS, -1])
def test_groups_are_joined_by_shuffles_but_for_few_components(spark, monkeypatch, most):
    plans, kept = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.update({name: plan(df)}) or kept(df, name))
    monkeypatch.setattr(simhash, "BROADCAST_LINKS", most)
    texts = ["a b c d e f", "a b c d e f", "g h i j k l", None]
    groups = simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [name for name, p in plans.items() if "BroadcastHashJoin" in p] == ["components"] * (most > 0)
    assert "Broadcast" not in plan(groups)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


@pytest.mark.parametrize("most", [components.BROADCAST_LINKS, 0])
def test_links_are_broadcast_by_their_number(spark, monkeypatch, most):
    plans, kept = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: plans.append(plan(df)) or kept(df, name))
    monkeypatch.setattr(components, "BROADCAST_LINKS", most)
    links = [(k, k + 1) for k in range(20)] + [(50, k) for k in range(51, 70)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 50 for k in range(50, 70)}
    assert {"BroadcastHashJoin" in p for p in plans[1:]} == {most > 0}
    assert {"SortMergeJoin" in p for p in plans[1:]} == {most == 0}


@pytest.mark.parametrize("most", [P.BROADCAST_IDS, 0])
def test_documents_that_go_are_broadcast_by_their_number(spark, monkeypatch, most):
    monkeypatch.setattr(P, "BROADCAST_IDS", most)
    texts = ["a b c d e f", "a b c d e f", "g h i j k l", "m n o p q r", "g h i j k l"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = P.one_of_each_group(spark, docs, "")
    assert ("Broadcast" in plan(found)) == (most > 0)
    assert {r["doc_id"] for r in found.collect()} == {0, 2, 3}
