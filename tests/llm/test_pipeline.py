"""The pipeline's stages against what their operators say, on a small fixture."""

import random

import corpus_pipeline as P
from siftline.llm.common import DOCUMENT_COLUMNS

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lines=8):
    words = "a tale of some small town where nothing ever happens and people like it so much that they stay".split()
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(10, 20))).capitalize() + "." for _ in range(lines))


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, prose(rng)) for k in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + "\nHome | News | Sport | Contact")]  # copies once lines are cleaned
    rows += [(200 + k, "\n".join("SO LOUD!! " * 12 for _ in range(6))) for k in range(20)]
    rows += [(300, rows[2][1] + '\nHere is a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" again.\n' + prose(rng)), (301, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DDL)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(200 + k, 0, 0) for k in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == DOCUMENT_COLUMNS
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"]: r for r in at.collect()}
    good = set(range(60)) | {100, 101, 300}
    assert set(left["quality rules"]) == good
    assert "Home |" not in left["quality rules"][101]["text"]
    assert set(left["quality classifier"]) == good
    assert set(left["simhash near-dedup"]) == good - {100, 101}
    assert "[SECRET]" in left["secret scans"][300]["text"] and "04dbebab" not in left["secret scans"][300]["text"]
    for r in left["secret scans"].values():
        assert r["n_chars"] == len(r["text"])
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == good - {100, 101}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(tokens.values())


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(4)
    a, b, c = prose(rng), prose(rng), prose(rng)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DDL)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in P.one_of_each_group(spark, docs, "").collect())
    assert got == sorted([(False, 1, a), (False, 5, b), (True, None, c), (True, None, c)])
