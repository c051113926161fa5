"""What keeps work and memory in proportion to the tables: columns made once, pages in pieces, rows that need no join."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline import catalog
from siftline.functions import html, markup
from siftline.operators import dedup, logins, records, search, store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_result_texts_are_made_once_for_each_platform(spark):
    assert plan(catalog.QUERIES["result_records"](spark, SF)).count("regexp_replace(") <= 8


def pages_batch(spark, df):
    """What an operator gives to ``mapInArrow``, in this process, over a batch of 64 pages of 0.25 MB, as rows a batch."""
    page = "<p>" + "word " * 50_000 + "</p>"
    given = {"page_id": list(range(64)), "url": ["https://a.b"] * 64, "__platform": ["p"] * 64, "platform": ["p"] * 64, "html": [page] * 64}
    return pa.RecordBatch.from_pydict({c: given[c] for c in df.columns})


@pytest.mark.parametrize("operator", [html.page_extract, records.crawled, html.page_markdown, lambda x: html.page_fields(x, {"t": "p"}), lambda x: search.results_of(x, "bing"), lambda x: markup.edited_pages(x, {"p": (["p"], [])}), logins.login_states])
def test_pages_are_read_in_pieces(spark, monkeypatch, operator):
    sizes = []

    def watched(df, rows, schema):
        sizes.extend(x.num_rows for x in rows(iter([pages_batch(spark, df)])))
        return whole(df, rows, schema)

    pages = spark.createDataFrame([(1, "u", "p", "<p>x</p>")], "page_id long, url string, platform string, html string")
    whole = type(pages).mapInArrow
    monkeypatch.setattr(type(pages), "mapInArrow", watched)
    operator(pages)
    assert sum(sizes) == 64
    assert max(sizes) <= 8


def test_new_contents_makes_a_batch_once(spark):
    kind = "pos int, content_hash string, url string, platform string"
    made = spark.createDataFrame([(1, "a", "u", "p"), (2, "a", "v", "p"), (3, None, "u", "p"), (4, None, "", None), (5, None, None, "p"), (6, "b", "", "p"), (7, "c", "w", None), (8, "d", "w", None), (9, "h", "x", "p")], kind)
    history = made.filter("pos = 9")
    found = dedup.new_contents(made.withColumn("url", F.concat("url", F.lit("~"))).withColumn("url", F.rtrim(F.col("url"), F.lit("~"))), history)
    assert [r["pos"] for r in found.orderBy("pos").collect()] == [1, 4, 5, 6, 7]
    assert sorted(found.columns) == sorted(made.columns)
    assert plan(found).count("concat(url") <= 1


def test_requests_without_a_video_are_not_joined_and_videos_not_broadcast(spark):
    videos = spark.createDataFrame([("v1", "completed")], "id string, status string")
    asked = spark.createDataFrame([(0, "v1", ["weibo"], "d"), (1, "", ["weibo"], "d"), (2, "v2", ["weibo"], "d")], "k int, video_id string, platforms array<string>, description string")
    found = store.with_publish_errors(asked, videos, ["weibo"])
    assert {r["k"]: r["error"] for r in found.collect()} == {0: None, 1: "video_required", 2: "video_missing"}
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in joins
    assert "Union" in joins


@pytest.mark.parametrize("css", [None, "p", ".none"])
def test_a_page_is_parsed_once(monkeypatch, css):
    parsed, plain = [], html.Tree
    monkeypatch.setattr(html, "Tree", lambda page: parsed.append(page) or plain(page))
    found = html.extracted("<title>t</title><nav>n</nav><a href=/k>k</a><main>m<header>h</header></main><p>x</p>", "https://a.b", css)
    assert found[1] == ("x" if css == "p" else "m")
    assert found[2] == "tnkmhx"
    assert [x["url"] for x in found[3]] == ["https://a.b/k"]
    assert len(parsed) == 1
