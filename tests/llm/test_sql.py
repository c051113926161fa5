"""Corpus queries that SQL can express against DuckDB over the smallest tables, and over hard rows."""

import os

import duckdb
import numpy as np
import pytest

from siftline.llm.embedding_dedup import embedding_groups, stars
from siftline.llm.oracles import ORACLES
from siftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def compared(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    df, found = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = sorted(str([dict(zip(found.columns, r, strict=True))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    compared(spark, SF, name)


def test_quality_rules_of_hard_rows(spark, tmp_path):
    texts = [None, "", " \n\n", "a b c a b c " * 30, "Home | News | x\n" * 5 + "word. " * 60, "UP UP UP UP UP UP UP\nsee é. " * 40, "Home About help!\nHome About help\nread more\nspread more\nplease log in\n" + "word. " * 60, "x\x0by\x1cz\x85 " * 60]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    compared(spark, str(tmp_path), "op7_quality_rules")


def test_embedding_links_in_sql(spark, tmp_path):
    base = [1.0, 0.0, 0.5, 0.25]
    rows = [(k, [x + 0.1 * ((k * j) % 3) for j, x in enumerate(base)], k % 2) for k in range(12)]
    rows += [(20, base, None), (21, None, 1), (22, [0.0] * 4, 1), (23, base, 0), (24, base, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    compared(spark, str(tmp_path), "op5_embedding_dedup")


def test_embedding_links_close_to_the_threshold_in_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for scale in (1.0, 1e160, 1e200, 1e-200):
        for k in range(60):
            x, y = rng.normal(size=24), rng.normal(size=24)
            x /= np.sqrt(x @ x)
            y -= (y @ x) * x
            y /= np.sqrt(y @ y)
            cos = 0.93 + rng.choice([-1e-3, -1e-5, -1e-7, 1e-7, 1e-5, 1e-3])
            for v in (x, cos * x + np.sqrt(1 - cos * cos) * y):
                rows.append((at, (scale * v).tolist(), k % 3 + 10 * int(np.log10(scale))))
                at += 1
    found = {r["vec_id"]: r for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = [np.array(v) / np.abs(v).max() for _, v, _ in rows]
    for k, (_, _, label) in enumerate(rows):
        links = [j for j, r in enumerate(rows) if j != k and r[2] == label and x[k] @ x[j] / np.sqrt(x[k] @ x[k]) / np.sqrt(x[j] @ x[j]) >= 0.93]
        assert found[k]["n_links"] == len(links), k
        assert (found[k]["component_id"] < k) == any(j < k for j in links) or len(links) > 1


def test_stars_join_what_links_join():
    rng = np.random.default_rng(5)
    for size in ((1, 1), (7, 9), (40, 30)):
        for share in (0.0, 0.02, 0.2):
            linked = rng.random(size) < share
            first, is_column, place = stars(linked)
            group = {}
            for r, c in zip(*np.nonzero(linked)):
                a, b = group.setdefault(("r", r), {("r", r)}), group.setdefault(("c", c), {("c", c)})
                if a is not b:
                    a |= b
                    group.update(dict.fromkeys(b, a))
            want = {frozenset(x) for x in group.values()}
            got = {}
            for r, col, k in zip(first.tolist(), is_column.tolist(), place.tolist()):
                got.setdefault(r, {("r", r)}).add(("c" if col else "r", k))
            assert {frozenset(x) for x in got.values()} == want
