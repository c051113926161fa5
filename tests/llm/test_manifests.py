"""Shards along the Hilbert curve, collocations and Merkle manifests against plain versions, and their edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import made_docs, rows_of
from test_sql import compared

from siftline.llm import merkle, phrases, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree string, size string, cells string, phrase string, curve string"


def hard_rows():
    """Null, empty, long and repeated rows, two large sources and a null one."""
    rows = [(*r[:2], "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, r[4], *["clash"] * 6) for k, r in enumerate(made_docs())]
    rows += [(1000 + k, f"copy {k % 7} A B", "de", "hot", 9, *["clash"] * 6) for k in range(700)]
    rows += [(3000 + k, "the cold war, Was the cold WAR? The cold war\tis", "en", "src1", 46, *["clash"] * 6) for k in range(20)]
    return rows + [rows[0], rows[3]] + [(-5, "x", "", "", None, *["clash"] * 6), (None, None, None, None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# shards


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 3), (3, 3), (4, 2), (2, 1)])
def test_the_curve_visits_each_point_once_and_goes_by_single_steps(spark, n, bits):
    points = [(list(p),) for p in itertools.product(range(1 << bits), repeat=n)]
    found = sorted((r["h"], r["x"]) for r in spark.createDataFrame(points, "x array<int>").select("x", sharding.hilbert_index("x", n, bits).alias("h")).collect())
    assert [h for h, _ in found] == list(range(len(points)))
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in itertools.pairwise(found))


def plain_index(x, bits):
    """The curve by recursion on Gray codes, as in the paper, without columns."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= (q - 1) * (x[-1] & q > 0)
        q >>= 1
    index = 0
    for k in range(bits - 1, -1, -1):
        for v in x:
            index = index * 2 + ((v ^ t) >> k & 1)
    return index


def plain_steps(v):
    power = (v + 1).bit_length() - 1
    return power * 32 + ((v + 1) * 32 >> power) - 32


def plain_shards(rows, shards=sharding.SHARDS):
    """(doc_id, size, checksum, shard, slot, curve) by one sorted list; ``rows`` have doc_id, text, lang, source, n_chars."""
    at = {"source": 3, "lang": 2, "n_chars": 4, "doc_id": 0}
    codes = []
    for d in sharding.DIMENSIONS:
        values = [r[at[d]] for r in rows]
        if d in ("n_chars", "doc_id"):
            least = min(v for v in values if v is not None)
            values = [None if v is None else plain_steps(v - least) for v in values]
        else:
            values = [None if v is None else v.encode() for v in values]
        counts, before, first = Counter(v for v in values if v is not None), 0, {}
        for v in sorted(counts):
            first.setdefault(before * 16 // sum(counts.values()), v)
            before += counts[v]
        cuts = sorted(first.values())[1:]
        codes.append([0 if v is None else min(15, 1 + sum(c <= v for c in cuts)) for v in values])
    lowest = lambda v: (v is not None, v)
    made = []
    for k, (i, text, lang, source, _) in enumerate(rows):
        raw = (text or "").encode()
        curve = plain_index([c[k] for c in codes], sharding.BITS)
        made.append(((curve, zlib.crc32(raw), lowest(i), lowest(source), lowest(lang)), i, len(raw) + 16))
    made.sort(key=lambda x: x[0])
    out, seen = [], Counter()
    for place, (key, i, size) in enumerate(made):
        shard = place * shards // len(made)
        out.append((i, size, key[1], shard, seen[shard], key[0]))
        seen[shard] += 1
    return out


def test_shards_against_one_sorted_list(hard):
    found = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["curve"]) for r in sharding.shard_map(hard).collect()]
    order = lambda x: (x[3], x[4])
    assert sorted(found, key=order) == plain_shards([r[:5] for r in hard_rows()])
    counts = Counter(r[3] for r in found)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1


def test_shards_of_few_or_no_rows(spark, none):
    found = rows_of(sharding.shard_map(spark.createDataFrame(hard_rows()[:3], DOCS)))
    assert sorted(r["slot"] for r in found) == [0, 0, 0] and len({r["shard"] for r in found}) == 3
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert sharding.shard_map(none).collect() == []
    assert sharding.hilbert_shards(none, law="bytes").collect() == []
    with pytest.raises(ValueError, match="law"):
        sharding.hilbert_shards(none, law="key")


def test_shards_of_equal_bytes_keep_columns(hard):
    found = rows_of(sharding.hilbert_shards(hard.drop("size", "curve"), 7, "bytes"))
    assert found[0].keys() >= {"text", "hash", "cells", "phrase", "size", "curve"}
    total, most = sum(r["size"] for r in found), max(r["size"] for r in found)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r)
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 7) <= most
    assert Counter(r["text"] for r in found) == Counter(r[1] for r in hard_rows())


def test_filters_leave_most_shards_out(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id doc_id", "'x' text", "concat('l', id * 7 % 13) lang", "concat('s', id * 11 % 17) source", "id * 37 % 1009 n_chars")
    sharded = sharding.hilbert_shards(docs, 64)
    sharding.written(sharded, f"{tmp_path}/shards", 8)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 4000
    ranges = sharding.shard_ranges(back).cache()
    for column, low, high in (("lang", "l5", "l5"), ("source", "s3", "s3"), ("n_chars", 100, 140), ("doc_id", 1000, 1100)):
        chosen = {r["shard"] for r in sharding.shards_with(ranges, column, low, high).collect()}
        assert {r["shard"] for r in back.filter(F.col(column).between(low, high)).select("shard").distinct().collect()} <= chosen
        assert len(chosen) <= 32, (column, len(chosen))


# collocations


def plain_collocations(rows, top, least, percent):
    found = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                found["und" if lang is None else lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in found.items():
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in long.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sum(n for p, n in f.items() if len(p) == 1), -score))
    return sorted(out)


@pytest.mark.parametrize(("top", "least", "percent"), [(2000, 30, 80), (9, 3, 80), (2000, 2, 50)])
def test_collocations_against_plain_counts(hard, top, least, percent):
    found = sorted(map(tuple, phrases.collocations(hard, top, least=least, percent=percent).collect()))
    assert found == plain_collocations(hard_rows(), top, least, percent) and found


def test_a_phrase_let_through_by_a_shared_bit_fails_by_its_count(hard, monkeypatch):
    words, n = phrases.levels(hard, 1)
    assert {r["lang"]: r["n"] for r in n.collect()}["de"] == 700 * 4
    full = phrases.np.full(phrases.BITMAP_BITS >> 6, 0xFFFFFFFFFFFFFFFF, phrases.np.uint64)
    pruned = phrases.level(hard, 2, phrases.bitmap_of(words.filter("size = 1"), 1))
    everything = phrases.level(hard, 2, hard.sparkSession.sparkContext.broadcast(full))
    frequent = lambda df: sorted(map(tuple, df.filter("n >= 30").collect()))
    assert frequent(pruned) == frequent(everything) and pruned.count() < everything.count()


def test_collocations_of_no_rows(none, spark):
    assert phrases.collocations(none).collect() == []
    blank = spark.createDataFrame([(1, None, "en"), (2, " .,\n", None), (3, "one", "en")], "doc_id long, text string, lang string")
    assert phrases.collocations(blank, least=1).collect() == []


def test_collocations_of_hard_rows_in_sql(spark, hard, tmp_path):
    hard.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    compared(spark, str(tmp_path), "op12_collocations")


# manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    for nodes in levels[:-1]:
        run = nodes[at - at % 16 : at - at % 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = [plain_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names]
    top = plain_tree([levels[-1][0] for levels in below])
    for k, s in enumerate(names):
        for at, (*_, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            lower = None if r[1] is None else re.sub("[A-Z]", lambda x: x[0].lower(), r[1])
            folded, proof = plain_leaf((r[0], lower, *r[2:])) if tampered else leaf, []
            for left, right in [*plain_path(below[k], at), *plain_path(top, k)]:
                proof += left + right
                folded = sha("".join([*left, folded, *right]))
            yield r[0], leaf, below[k][-1][0], top[-1][0], sha("".join(proof)), folded, folded == top[-1][0]


def test_manifest_against_whole_trees(hard):
    key = lambda x: tuple(map(str, x))
    found = [tuple(r) for r in merkle.merkle_manifest(hard).collect()]
    assert sorted(found, key=key) == sorted(plain_manifest(hard_rows()), key=key)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 2


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4096, 4097])
def test_trees_at_the_borders_of_superblocks(spark, n):
    nodes = spark.range(n).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash"))
    want = plain_tree([sha(str(k)) for k in range(n)])
    rounds = merkle.reduced(nodes)
    assert [r["hash"] for r in rounds[-1].collect()] == want[-1]
    none = F.array().cast("array<int>")
    root = rounds[-1].select("tree", "idx", F.lit("").alias("subroot"), F.col("hash").alias("root"), F.lit("").alias("siblings"), none.alias("positions"), none.alias("sizes"))
    for r in merkle.all_proven(rounds, root).withColumn("folded", merkle.folded(F.col("hash"))).collect():
        assert r["folded"] == want[-1][0]
        assert r["siblings"] == "".join("".join(a + b) for a, b in plain_path(want, r["idx"]))


def test_manifest_of_one_or_no_row(spark, none):
    assert merkle.merkle_manifest(none).collect() == []
    (one,) = rows_of(merkle.merkle_manifest(spark.createDataFrame(hard_rows()[:1], DOCS)))
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("")


def test_proofs_hold_for_ids_over_53_bits(spark):
    big = 2**60 + 1
    rows = [(big + k, "a", "en", "s", 1) if k else (None, "a", "en", "s", 1) for k in range(40)]
    found = rows_of(merkle.merkle_proofs(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert {r["doc_id"] for r in found} == {r[0] for r in rows}


def test_manifest_of_hard_rows_in_sql(spark, hard, tmp_path):
    distinct = hard.dropDuplicates(["doc_id"])  # in SQL a null id and equal rows would meet twice
    distinct.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    compared(spark, str(tmp_path), "op13_merkle_manifest")
