"""The corpus operators against brute-force versions, round trips and held-out accuracy, and their edge cases."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import (
    chat_format,
    embedding_dedup,
    gru,
    license_scan,
    lm_scoring,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_nbest,
    simhash,
)
from siftline.llm.components import components

SPACES = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, bits string, score string, part string"


def made_docs(seed=3):
    """Null, empty, blank, very long and repeated texts and ids, copies and near copies."""
    rng = random.Random(seed)
    words = ["the", "of", "Ärger", "tion.", "and,", "xx", "été", "ing", "a|b", "$$$"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(n))
    long = text(9000)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, long), (4, long), (5, "one"), (5, "one"), (None, "no id"), (7, "two words"), (8, None)]
    for k in range(10, 40):
        rows.append((k, text(rng.randrange(1, 200))))
    base = text(300)
    rows += [(50 + k, base + " end" + str(k)) for k in range(5)]
    return [(i, t, "en", "src0", None if t is None else len(t), "clash", "clash", "clash", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def texts_by_row(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def same(got, want):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


# quality rules


def plain_rules(text):
    words = re.findall(SPACES, text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(SPACES, line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), failed


def test_quality_rules_base(docs):
    got = rows_of(quality_rules.quality_rules(docs, with_text=False))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same([tuple(r[n] for n in names) for r in got], [(i, *plain_rules(t)) for i, t in texts_by_row(docs)])
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_repeated_words_of_many_kinds():
    rng = random.Random(1)
    for n in range(60):
        words = [rng.choice("abcd").encode() for _ in range(n)]
        windows = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
        inside = {k + j for k in range(n - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        assert quality_rules.repeated_words(words) == len(inside)


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        (b"Home | News | Sport | Contact", "navigation"),
        (b"buy&&& now*** all$$$ is%%% cheap###", "punctuation"),
        (b"WHO SAYS THAT THIS IS LOUD ENOUGH", "punctuation"),
        (b"so so so so so so so so so so so", "repetition"),
        (b"2020 Example Inc. All rights reserved.", "boilerplate"),
        (b"A quiet sentence about nothing at all.", ""),
        (b"She had always wanted to read more.", ""),
        (b"The plague spread more widely.", ""),
        (b"Read more", "boilerplate"),
        (b"Home About Contact Help", "navigation"),
        (b"Please contact us at home.", ""),
        ("\u092f\u0939 " .encode() * 20 + "\u0939\u0948 \u0915\u0939\u093e \u0925\u093e \u092a\u0930 \u0938\u092c \u0932\u094b\u0917 \u0906\u090f \u0914\u0930 \u0917\u090f \u0964".encode(), ""),
        (b"", ""),
    ],
)
def test_line_rules(line, rule):
    assert quality_rules.line_fails(line) == rule


def test_quality_rules_keep_prose_and_cut_lines(spark):
    rng = random.Random(1)
    words = "a tale of some small town where nothing ever happens and people like it so".split()
    prose = "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(12))
    docs = spark.createDataFrame([(1, prose + "\nHome | News | Sport | Contact"), (2, "A B C | D E F | G H | " * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(quality_rules.quality_rules(docs))}
    assert got[1]["kept"] and got[1]["cleaned"] == prose
    assert not got[2]["kept"]


# secrets


def plain_base(text):
    """The base patterns by the letter: leftmost matches of the whole pattern, failing ones dropped."""
    found = []
    low = "".join(c.lower() if c.isascii() else c for c in text)
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
    found += [(m.start(), 0, m.end()) for m in assign.finditer(low) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_base_spans(spark):
    rng = random.Random(5)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", ":", "=", '"', "'", " ", "x", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "abc123+/=", "é", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows_of(secret_scan.secret_scan(docs)):
        base = plain_base(texts[r["doc_id"]] or "")
        line = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_guess_costs():
    cost = secret_scan.log10_guesses
    assert cost("") == 0
    for weak in ("password1", "qwertyuiop", "20240131", "aaaaaaaaaaaa", "abcabcabcabc", "asdfghjkl123"):
        assert cost(weak) < 7, weak
    for strong in ("xK9#mQ2$vL7p", "f3ef4d6b2755a36d7d9c25"):
        assert cost(strong) > 15, strong
    # a segmentation is never dearer than one brute-force span
    rng = random.Random(2)
    for _ in range(200):
        v = "".join(rng.choice("abcpasswordqwe123!A") for _ in range(rng.randrange(1, 20)))
        assert cost(v) <= len(v) * math.log10(secret_scan.alphabet(v)) + 1e-9


def test_weak_passwords_are_cheap():
    cost = secret_scan.log10_guesses
    for weak in ("Liverpool1", "manchester99", "1qaz2wsx3edc", "zaq1xsw2cde3", "basketballchampion", "aaaaasdferty", "31121999", "p4ssw0rd2024"):
        assert cost(weak) < secret_scan.MIN_LOG10_GUESSES, (weak, cost(weak))
    for strong in ("k9#Fz!2pQw7$", "Tr0ub4dor.horse!9x&Qz", "hunZ7vPq2LmW4c"):
        assert cost(strong) > secret_scan.MIN_LOG10_GUESSES, (strong, cost(strong))
    assert cost("a" * 100_000) < 4  # in linear time


def cheapest_span(value, i, j):
    """The cheapest single segment that is value[i:j], by the definitions alone."""
    v = value[i:j]
    low = v.lower()
    each = math.log10(secret_scan.alphabet(value))
    costs = [len(v) * each]
    place, longest = secret_scan.ranks()
    if 3 <= len(v) <= longest:
        for form, changed in ((low, 0), (low.translate(secret_scan.LEET), 1)):
            if form in place:
                costs.append(math.log10(place[form] + 1) + 0.3 * ((v != low) + 2 * changed))
                break
    costs += [math.log10(n) for form, n in secret_scan.DATES if form.fullmatch(v)]
    for p in range(1, min(secret_scan.LONGEST_PERIOD, len(v) // 2) + 1):
        if all(v[k] == v[k - p] for k in range(p, len(v))):
            costs.append(p * each + secret_scan.TIMES)
    if len(v) >= 3:
        ways = [secret_scan.STEPS.get(x) for x in zip(low, low[1:])]
        if all(ways):
            costs.append(secret_scan.BEGIN + secret_scan.LENGTH + secret_scan.TURN * sum(a != b for a, b in zip(ways, ways[1:])))
        turns = {secret_scan.in_order(a, b) for a, b in zip(low, low[1:])}
        if turns in ({1}, {-1}):
            costs.append(secret_scan.ORDER + secret_scan.LENGTH)
    return min(costs)


def test_guess_costs_against_all_segmentations():
    rng = random.Random(6)
    pool = ["abc", "qaz", "123", "the", "2024", "01", "aa", "xyx", "L0v3", "!", "Q", "zse4", "love"]
    values = ["".join(rng.choice(pool) for _ in range(4))[: rng.randrange(1, 11)] for _ in range(150)]
    values += ["".join(rng.choice("ab12sdA") for _ in range(rng.randrange(1, 10))) for _ in range(150)]
    for value in values:
        n = len(value)
        spans = {(i, j): cheapest_span(value, i, j) for i in range(n) for j in range(i + 1, n + 1)}
        every = []
        for cuts in range(n):
            for places in itertools.combinations(range(1, n), cuts):
                edges = [0, *places, n]
                every.append(secret_scan.CUT * cuts + sum(spans[e] for e in zip(edges, edges[1:])))
        assert math.isclose(secret_scan.log10_guesses(value), min(every)), value


def test_secrets_are_masked_and_prose_is_left():
    strong, weak, prose = "the pwd=xK9#mQ2$vLpp ok", "the pwd=qwertyuiop ok", "He is the author of a secret: love."
    for text, masked in ((strong, "the pwd=[SECRET] ok"), (weak, weak), (prose, prose)):
        assert secret_scan.redacted(text, secret_scan.scan(text)[1]) == masked


def test_a_base_span_on_part_of_a_value_leaves_none_of_it():
    for value in ("Tr0ub4dor.horse!9x&Qz", "zK#deadbeef01234567!Qw&9", "Tr0ub4dor.horse!deadbeef01234567!Q"):
        text = f'say password = "{value}" here'
        base, spans = secret_scan.scan(text)
        assert base and (text.index(value), 3, text.index(value) + len(value)) in spans
        masked = secret_scan.redacted(text, spans)
        assert masked.startswith("say ") and masked.endswith('[SECRET]" here') and not any(x in masked for x in ("!", "#", "&"))
    whole = "password=Tr0ub4dor.horse/9xQz"
    assert secret_scan.scan(whole)[1] == [(0, 0, len(whole))]


def test_a_cue_may_follow_any_letters_or_digits():
    for key in ("dbPassword", "PGPASSWORD", "clientSecret", "accessToken", "authToken", "sessionToken", "dbPass", "x2pwd", "éToken", "my-db_pass"):
        for text in (f'{{"{key}": "k9#Fz!2pQw7$"}}', f"{key}=k9#Fz!2pQw7$ ", f"{key} => k9#Fz!2pQw7$\n", f"{key}: k9#Fz!2pQw7$;"):
            masked = secret_scan.redacted(text, secret_scan.scan(text)[1])
            assert masked == text.replace("k9#Fz!2pQw7$", "[SECRET]"), text
    # a cue in another's value still counts, a value in a value is part of it
    assert secret_scan.scan("authToken: dbPassword: k9#Fz!2pQw7$")[1][-1] == (23, 3, 35)
    assert secret_scan.scan("dbtoken=password=k9#Fz!2pQw7$")[1] == [(8, 3, 29)]


# quality classifier


def chain_marginals(unary, change):
    n = len(unary)
    total, one = 0.0, np.zeros(n)
    for ys in itertools.product((0, 1), repeat=n):
        s = sum(u for u, y in zip(unary, ys, strict=True) if y) + sum(change[a][b] for a, b in zip(ys, ys[1:], strict=False))
        total += math.exp(s)
        one += math.exp(s) * np.array(ys)
    return one / total


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        u, c = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        want = chain_marginals(u, c)
        assert np.allclose(quality_classifier.marginals(u.tolist(), np.exp(c).tolist()), want)
        scores = np.zeros((n, 1, 2))
        scores[:, 0, 1] = u
        assert np.allclose(quality_classifier.expected(scores, np.array([n]), c)[0][:, 0, 1], want)


def good_and_bad(n=240, seed=4):
    rng = random.Random(seed)
    words = "a tale of some small town where nothing ever happens and people like it so".split()
    out = []
    for k in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 20))).capitalize() + "." for _ in range(rng.randrange(2, 8))]
        if k % 4 == 0:
            lines[1:] = [" ".join(rng.choice(words).upper() + "!!" for _ in range(12)) for _ in lines[1:]]
        out.append((k, "\n".join(lines), int(k % 4 != 0)))
    return out


def test_quality_classifier_on_held_out_documents(spark):
    rows = good_and_bad()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (1000, None), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_classifier.quality_classifier(docs, labels))
    assert len(got) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1000}) == 1


def test_quality_classifier_with_repeated_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "RUN_LINES", 4)
    rows = good_and_bad()
    twice = [(i, "ANOTHER!! TEXT!! " * 9) for i, _, y in rows if y and i % 5 == 0]
    texts = [(i, t) for i, t, _ in rows] + twice + [(4, "\n".join([rows[4][1]] * 1800))]
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")

    def scores(given):
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        return sorted((r["doc_id"], r["score"]) for r in rows_of(quality_classifier.quality_classifier(docs, labels)))

    assert scores(texts) == scores(texts[::-1])
    features, sizes = quality_classifier.line_features(texts[-1][1].encode())
    own, _ = quality_classifier.line_features(rows[4][1].encode())
    assert len(features) == len(sizes) == 1800 * len(own) > quality_classifier.BLOCK_LINES
    assert np.array_equal(features[:1, :10], own[:1, :10]) and np.array_equal(features[-1:, :20], own[-1:, :20])


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(10, 1, 0), (11, 1, 0)], 1.0), ([(10, 0, 0)], 0.0)])
def test_quality_classifier_without_two_kinds_of_labels(spark, docs, labels, score):
    kept = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1] or labels
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["score"] for r in rows_of(quality_classifier.quality_classifier(docs, df))}
    assert got == ({score} if len(kept) == len(labels) and all(zlib.crc32(str(x[0]).encode()) % 3 != 1 for x in labels) else got)


# SimHash


def plain_fingerprint(text):
    words = re.findall(SPACES, "".join(c.lower() if c.isascii() else c for c in text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_simhash(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(j, k) for j, k in itertools.combinations(range(len(rows)), 2) if (prints[j] ^ prints[k]).bit_count() <= 3]
    of = least_reachable(range(len(rows)), near)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[of[k]].append(i)
    return [(i, f"{prints[k]:016x}", min((x for x in least[of[k]] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_simhash_against_all_pairs(docs):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.simhash_groups(docs))]
    same(got, plain_simhash(texts_by_row(docs)))


@pytest.mark.parametrize("hot", [simhash.HOT_KEY, 1])
def test_simhash_links_of_a_dense_ball(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = random.Random(8)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(40)}
    values = sorted(v - (v >> 63 << 64) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "bits long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in rows_of(simhash.links(df))}
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    got = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(links, "a long, b long")))}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == least_reachable({x for p in real for x in p}, real)


# embeddings


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 24))
    rows, n = [], 0
    for _ in range(150):
        v = centres[rng.integers(6)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])
        rows.append((n, [float(np.float32(x)) for x in v], int(rng.integers(2))))
        n += 1
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(5)]
    n += 5
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 6, rows[0][1], None), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (None, [9.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("code", F.lit("x"))
    whole = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    links = [
        (j, k)
        for j, k in itertools.combinations(whole, 2)
        if rows[j][2] == rows[k][2] and len(rows[j][1]) == len(rows[k][1]) and cosine(rows[j][1], rows[k][1]) >= 0.93
    ]
    count = Counter(x for p in links for x in p)
    of = least_reachable(range(len(rows)), links)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[of[k]].append(r[0])
    want = []
    for k, r in enumerate(rows):
        first = min((x for x in least[of[k]] if x is not None), default=None)
        want.append((r[0], count[k], first, r[0] == first))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(embedding_dedup.embedding_groups(df))]
    same(got, want)


# packing


def test_packing_is_an_exact_partition_of_every_document(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows_of(packing.pack(docs, with_ids=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for i, t in texts_by_row(docs):
        wanted[i].append(np.array([*tool.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert pieces.keys() == wanted.keys()
    for i, ids in wanted.items():
        for whole in set(ids):
            mine = sorted(p for p in pieces[i] if 4 * p[2] == len(whole) and whole[4 * p[0] : 4 * p[0] + len(p[1])] == p[1])
            assert b"".join(p[1] for p in mine[:: ids.count(whole)]) == whole
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_words_are_tokenized_alone_as_in_their_text():
    tool = packing.tokenizer(None)
    texts = ["x <|ENDOFTEXT|> <|endoftext|>, Été. A, I. 5. x5, é.", "a\x1cb..\x1d.. ´é a　b\xa0c ΣΑΣ. It's don't 12ab!?", "", " \n "]
    for text, ids in zip(texts, packing.ids_of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tool.encode(text, add_special_tokens=False).ids, 1]


def test_a_word_with_signs_after_it_is_not_tokenized_again(monkeypatch):
    packing._tokenizers.clear()
    tool, seen = packing.tokenizer(None), Counter()
    for name in ("encoded", "encoded_plain"):
        whole = getattr(packing, name)
        monkeypatch.setattr(packing, name, lambda words, tool, whole=whole: (seen.update(w for w in words if w[:1].isalpha()), whole(words, tool))[1])
    texts = ["rösti rösti, rösti$$$ rösti.%%% (rösti) stone!!", "rösti&&& stone?! stone STONE's"]
    for text in texts:
        assert np.frombuffer(packing.ids_of([text.encode()])[0], "<u4").tolist() == [*tool.encode(text, add_special_tokens=False).ids, 1]
    assert seen == {"rösti": 1, "stone": 1, "stone's": 1}


@pytest.mark.parametrize("most", [0, 40, 600_000])
def test_words_of_letters_and_signs_are_tokenized_as_in_their_text(monkeypatch, most):
    monkeypatch.setattr(packing, "CACHE_WORDS", most)
    packing._tokenizers.clear()
    tool, rng = packing.tokenizer(None), random.Random(8)
    parts = ["a", "the", "stone", "É", "ß", "÷", "e\u0301", "\u0301", "\u0338", "…", "7", "²", "'", "'s", "'ll", "<|", "|>", "<|endoftext|>", "ǆ", "漢", "🙂", "ÿ", *packing.SIGNS]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(1500)]
    for at in range(0, 1500, 100):
        texts = [" ".join(rng.choices(words[at : at + 150], k=60)) for _ in range(8)] + [" ".join(words[at : at + 100])]
        for text, ids in zip(texts, packing.ids_of([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*tool.encode(text, add_special_tokens=False).ids, 1]


def test_neighbours_share_words():
    ids = lambda *x: np.array(x, "<u4").tobytes()
    shard = packing.Shard([(0, 0, 3, ids(5, 6, 1)), (1, 0, 3, ids(7, 8, 1)), (2, 0, 3, ids(5, 9, 1))], np.array([0, 0, *[2.0] * 10]), 3.0)
    assert shard.neighbours(0).tolist() == [2]


def test_neighbours_are_scored_by_all_words_of_the_seed():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(100, 400, rng.integers(1, 200))) for _ in range(60)]
    sets[0] = np.arange(100)  # all but the last of its words are the seed's own
    sets[0][-1] = sets[1][0]
    idf = rng.random(400) + 0.1
    idf[:99] = 9.0
    shard = packing.Shard([(k, 0, len(x), x.astype("<u4").tobytes()) for k, x in enumerate(sets)], idf, 50.0)
    for gone in (0, 40):
        shard.unused[5 : 5 + gone] = False
        for seed in (0, 1, 2, 3):
            score = {k: sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(x) / 50)) for t in np.intersect1d(x, sets[seed])) for k, x in enumerate(sets)}
            wanted = sorted((k for k in score if k != seed and shard.unused[k] and score[k]), key=lambda k: -score[k])
            assert wanted and shard.neighbours(seed).tolist() == wanted


# language model


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(gru, "FLOAT", np.float64)
    rng = np.random.default_rng(0)
    shape = gru.Shape(np.array([0, 1, 4, 9]), 3)
    p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in gru.start(shape, rng.random(shape.ids) + 0.1).items()}
    x, y = rng.integers(0, shape.ids, (5, 4)), rng.integers(0, shape.ids, (5, 4))
    keep, h = (rng.random((5, 4)) > 0.2).astype(float), rng.normal(0, 0.5, (4, gru.HIDDEN))
    g, _, _ = gru.gradients(p, shape, x, y, h, keep)
    dense = np.zeros_like(p["x"])
    dense[g["x"][0]] = g["x"][1]
    g["x"] = dense

    def value():
        return gru.log_probabilities(p, shape, gru.run(p, x, h, keep)[0].reshape(-1, gru.HIDDEN), y.ravel()).sum()

    for name in p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            was, e = p[name][at], 1e-5
            p[name][at] = was + e
            up = value()
            p[name][at] = was - e
            down = value()
            p[name][at] = was
            assert abs((up - down) / 2 / e - g[name][at]) < 1e-6


def test_documents_are_scored_alike_alone_and_together():
    rng = np.random.default_rng(3)
    shape = gru.Shape(np.array([0, 3, 9]), 4)
    p = gru.start(shape, rng.random(shape.ids) + 0.1)
    p["c"] += rng.normal(size=p["c"].shape).astype(np.float32)
    docs = [rng.integers(0, shape.ids, n) for n in (1, 40, 17, 16, 33, 2)]
    ins = [lm_scoring.shifted(d, 0) for d in docs]
    together = gru.score_documents(p, shape, ins, docs)
    assert np.allclose(together, [gru.score_documents(p, shape, [i], [d])[0] for i, d in zip(ins, docs, strict=True)], atol=1e-3)
    # probabilities of all tokens sum to one
    state = rng.normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = gru.log_probabilities(p, shape, np.repeat(state, shape.ids, 0), np.arange(shape.ids))
    assert abs(np.exp(every).sum() - 1) < 1e-5


def test_lm_base_scores(docs):
    rows = texts_by_row(docs)
    tokens = [[*(w.lower() for w in t.encode().split()), b""] for _, t in rows]
    held = [zlib.crc32((b"" if i is None else str(i).encode())) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = [
        (i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
        for (i, _), h, ws in zip(rows, held, tokens, strict=True)
    ]
    got = rows_of(lm_scoring.lm_scores(docs))
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lm_words_are_numbered_as_one_by_one(monkeypatch):
    """And work on each occurrence is Arrow's: once tables are made, no class is worked out in Python."""
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 6)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 2}))
    texts = ["The cat THE cat a", None, "", " \x0b\n", "x\x1cy É é\r É\x0c\x00 \x85\xa0z", "ab b ab zb the end", "漢 字 漢 a\tb  ", *(f"the w{k} cat w{k % 7}" for k in range(300))]
    words = [[*(w.lower() for w in (t or "").encode().split()), b""] for t in texts]
    batch = pa.record_batch({"doc_id": pa.array([None, *range(1, len(texts))], pa.int64()), "text": texts})
    calls, plain = [], lm_scoring.rare_class
    monkeypatch.setattr(lm_scoring, "rare_class", lambda w: (calls.append(w), plain(w))[1])
    list(lm_scoring.count_words([batch.select(["text"])]))
    calls.clear()
    counted = [r for b in lm_scoring.count_words([batch.select(["text"]).slice(3), batch.select(["text"]).slice(0, 3)]) for r in b.to_pylist()]
    assert len(calls) < 10
    counts = Counter(w for ws in words for w in ws)
    found = Counter()
    for r in counted:
        assert r["class"] == plain(r["word"].encode())
        found[r["word"].encode()] += r["n"]
    assert found == counts
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]
    classes: dict = {}
    for w, n in counts.items():
        if w not in dict(head[:6]):
            mass, kinds = classes.get(plain(w), (0, 0))
            classes[plain(w)] = (mass + n, kinds + 1)
    vocabulary = lm_scoring.Vocabulary(head, classes, sum(counts.values()), len(counts))
    calls.clear()
    got = [r for b in lm_scoring.encode([batch.slice(0, 2), batch.slice(2)], vocabulary) for r in b.to_pylist()]
    assert len(calls) < 10
    place = {w: k for k, (w, _) in enumerate(head)}
    for k, (r, ws) in enumerate(zip(got, words, strict=True)):
        heads, rare = [w for w in ws if w in place], Counter(w.decode() for w in ws if w not in place)
        numbers = [place[w] if place.get(w, 6) < 6 else 6 + plain(w) for w in ws]
        assert np.frombuffer(r["numbers"], "<i2").tolist() == numbers
        assert (r["row"], r["doc_id"], r["n_tokens"], r["head_known"]) == ((2 << 40) + k, k or None, len(ws), len(heads))
        assert r["held_out"] == (zlib.crc32(str(k).encode() if k else b"") % 10 == 0)
        assert dict(zip(r["rare_words"], r["rare_counts"], strict=True)) == rare
        assert abs(r["head_log"] - sum(math.log10(counts[w] + 0.1) for w in heads)) < 1e-9
        within = sum((math.log10(counts[w] + 0.1) if w in place else 0) - math.log10(vocabulary.rare_mass[plain(w)]) for w, x in zip(ws, numbers, strict=True) if x >= 6)
        assert abs(r["within"] - within) < 1e-9


def test_lm_learns_what_follows_what(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        kind = rng.choice(["ab", "cd"])
        rows.append((k, " ".join(kind[j % 2] * 2 for j in range(60))))
    got = rows_of(lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


# chat


def test_chat_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 3)
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None), (None, "x")]
    rows = []
    for conv, turns in ((1, talk[:2]), (2, talk), (3, talk[:4]), (4, talk), (None, talk[:1]), (6, [("user", "hi"), ("user", "hello")]), (9, [])):
        rows += [(conv, k, r, t, "clash") for k, (r, t) in enumerate(turns)]
    rows += [(7, None, "user", "a", "clash"), (7, None, "user", "a", "clash")]
    got = rows_of(chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, place string")))
    assert {(r["conv_id"], r["part"], r["n_turns"], r["n_copies"]) for r in got} == {(2, 0, 5, 2), (2, 1, 5, 2), (6, 0, 2, 1), (7, 0, 2, 1)}
    text = "".join(r["text"] for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["part"]))
    assert text == "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in talk)


def test_chat_with_hot_conversations_against_plain_prefixes(spark):
    """Rows without id or number, and one row many times, are dealt over several tasks; results are as of lists."""
    rng = random.Random(9)
    rows = [(None, None, "user", "again") for _ in range(400)] + [(None, k % 3, "user", rng.choice("ab")) for k in range(90)]
    rows += [(1, 1, "user", "same") for _ in range(300)]
    talk = [(rng.choice(["user", "assistant"]), rng.choice("xyz")) for _ in range(60)]
    for conv in range(2, 40):
        rows += [(conv, k, *t) for k, t in enumerate(talk[: rng.randrange(1, 60)])]
    rng.shuffle(rows)
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is None, turn or 0, role, text))
    lists = {c: tuple((r, t) for _, _, r, t in sorted(x)) for c, x in talks.items()}
    want = {}
    for c, own in lists.items():
        equal = [d for d, x in lists.items() if x == own]
        if c == min(equal, key=lambda d: (d is None, d or 0)) and not any(len(x) > len(own) and x[: len(own)] == own for x in lists.values()):
            want[c] = (len(own), len(equal), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in own))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    parts = defaultdict(list)
    for r in rows_of(chat_format.chat_format(df)):
        parts[r["conv_id"]].append((r["part"], r["n_turns"], r["n_copies"], r["text"]))
    assert {c: (*sorted(x)[0][1:3], "".join(y[3] for y in sorted(x))) for c, x in parts.items()} == want


def test_chat_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert rows_of(chat_format.chat_format(empty)) == []


# licences


@pytest.fixture(scope="module")
def licences():
    return license_scan.train()


def test_every_template_is_found_and_other_text_isn_t(licences):
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            text = f"Some words before.\n{t}.\nAnd after."
            assert [(text[a:b], f) for a, b, f, _ in licences.scan(text)] == [(t, family)]
    for t in [*license_scan.OTHERS, "under the free version 2 terms", "license", ""]:
        assert licences.scan(t) == []


def test_a_notice_in_a_very_long_paragraph(licences):
    words = ["rain"] * 5000
    words[3210:3210] = "Released under the MIT License".split()
    assert [f for _, _, f, _ in licences.scan(" ".join(words))] == ["mit"]


def test_wrapped_notices_and_identifiers(licences):
    gpl = "This program is free software: you can redistribute it and/or modify\n{0}it under the terms of the GNU General Public License as published by\n{0}the Free Software Foundation, either version 3 of the License, or\n{0}(at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\n{0}modification, are permitted provided that the following conditions\n{0}are met:"
    for sign in ("", "# ", " * ", "// "):
        assert [f for _, _, f, _ in licences.scan(sign + gpl.format(sign))] == ["gpl-3.0"]
        assert [f for _, _, f, _ in licences.scan(sign + bsd.format(sign))] == ["bsd"]
        text = f"{sign}SPDX-License-Identifier: MIT\nint x;"
        assert [(text[a:b], f) for a, b, f, _ in licences.scan(text)] == [("SPDX-License-Identifier: MIT", "mit")]
    assert {f for _, _, f, _ in licences.scan("SPDX-License-Identifier: (GPL-2.0-or-later OR Apache-2.0)")} == {"gpl-2.0", "apache-2.0"}


def test_repeated_and_dual_notices(licences):
    words = ["rain"] * 9500
    for at in (9000, 5000, 100):
        words[at:at] = "Released under the MIT License".split()
    text = " ".join(words)
    assert [(text[a:b], f) for a, b, f, _ in licences.scan(text)] == [("Released under the MIT License", "mit")] * 3
    for text in (
        "licensed under the MIT License or licensed under the Apache License, Version 2.0",
        "Licensed under the MIT License or the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 or the MIT license",
    ):
        assert sorted(f for _, _, f, _ in licences.scan(text)) == ["apache-2.0", "mit"]


# N-best segmentation


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_nbest.Lattice(None, 4)


def all_segmentations(lattice, text):
    """(score, number of ids, ids) of every segmentation, best first; of equal scores fewer ids first."""
    text = sentencepiece_nbest.MARK + text.replace(" ", sentencepiece_nbest.MARK) if text else ""
    found = []

    def go(at, value, ids):
        if at == len(text):
            units = (value + len(ids)) // sentencepiece_nbest.FINE
            found.append((-units, len(ids), ids))
            return
        single = False
        for end in range(at + 1, min(len(text), at + lattice.longest) + 1):
            p = lattice.pieces.get(text[at:end])
            if p:
                go(end, value + p[1], (*ids, p[0]))
                single |= end == at + 1
        if not single:
            own = [lattice.bytes[x] for x in text[at].encode()]
            go(at + 1, value + lattice.unknown * len(own), (*ids, *own))

    go(0, 0, ())
    return [(-u * sentencepiece_nbest.UNIT, n, ids) for u, n, ids in sorted(found)]


def test_words_met_again_are_not_worked_on_again(lattice, monkeypatch):
    monkeypatch.setattr(sentencepiece_nbest, "CACHE_WORDS", 2)
    monkeypatch.setattr(sentencepiece_nbest, "CACHE_SEARCHED", 1)
    monkeypatch.setattr(lattice, "cache", {})
    monkeypatch.setattr(lattice, "searched", {})
    worked, searched = [], []
    monkeypatch.setattr(lattice, "best", lambda words, f=lattice.best: [worked.extend(words), f(words)][1])
    monkeypatch.setattr(lattice, "searched_words", lambda words, f=lattice.searched_words: [searched.extend(words), f(words)][1])
    first, second, third = (lattice.looked_up(x.split()) for x in ("a b c d", "b c e", "b e a"))
    assert worked == ["a", "b", "c", "d", "e", "a"] and second[0] == first[1] and third[2] == first[0]
    every = [lattice.choices(set(x)) for x in ("ab", "bc", "b")]
    assert searched == ["a", "b", "c"] and every[2]["b"] == every[0]["b"]


def test_edges_are_sorted_alike_in_words_of_any_length(lattice, monkeypatch):
    words = ["internationalization" * 30, "x", "\u4f60\u597dthe", "aaaa"]
    short = lattice.best(words)
    monkeypatch.setattr(sentencepiece_nbest, "MOST_NODES", 0)
    assert lattice.best(words) == short


@pytest.mark.parametrize("sizes", [(), (1,), (4,), (4, 4), (4, 1, 3), (4, 4, 4)])
def test_no_choice_beyond_the_tried_ones_is_among_the_best(sizes):
    rng = random.Random(5)
    for _ in range(50):
        losses = [[0, *sorted(rng.choice([0, 1, 1, 2, 5]) for _ in range(k - 1))] for k in sizes]
        best = [heapq.nsmallest(4, ((sum(x[c] for x, c in zip(losses, choice, strict=True)), choice) for choice in tried))
                for tried in (itertools.product(*map(range, sizes)), sentencepiece_nbest.chosen(sizes, 4))]
        assert best[0] == best[1]


def test_nbest_against_all_segmentations(lattice):
    rng = random.Random(2)
    texts = ["hello a", "", "x\nth re", "☃ of", " a", "  ", "été à", "一 你好😀", "aaaaaaaaaa"]
    texts += ["".join(rng.choice("thean on") for _ in range(10)) for _ in range(25)]
    texts += ["".join(rng.choice(["a", " ", "\n", "ing", "Ä", "你", "😀", "ss"]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    for text, (found, _) in zip(texts, lattice.encoded(texts), strict=True):
        every = all_segmentations(lattice, text)
        ids = [tuple(np.frombuffer(b"".join(runs), "<u4").tolist()) for *_, runs in found]
        assert [(s, n) for s, n, _ in found] == [(s, n) for s, n, _ in every[:4]]
        known = {x: (s, n) for s, n, x in every}
        assert [known[x] for x in ids] == [(s, n) for s, n, _ in found] and len(set(ids)) == len(ids)
        assert all(lattice.decode(list(x)) == text for x in ids)
        assert lattice.encode(text) == [(s, b"".join(runs)) for s, _, runs in found]


def test_merges_are_the_models_own(lattice):
    texts = [t or "" for _, t, *_ in made_docs()] + ["x\n\ny  z", " \n", "\t\u00a0你好 😀a", "a▁b", "foo\nbar baz\n  qux"]
    for text, (_, merged) in zip(texts, lattice.encoded(texts), strict=True):
        assert np.frombuffer(merged, "<u4").tolist() == lattice.model.encode(text)


def test_long_words_take_linear_steps(lattice):
    rng = random.Random(5)
    for word, n in (("a" * 20_000, 4), ("".join(rng.choice("abcXYZ019+/") for _ in range(20_000)), 4), ("你好" * 10_000, 1)):
        found, _ = next(lattice.encoded([word]))
        assert len(found) == n and all(a[0] >= b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(lattice.decode(b"".join(runs)) == word for *_, runs in found)


def test_nbest_round_trip(spark, docs):
    coded = sentencepiece_nbest.encode_nbest(docs)
    assert all(r["round_trip"] for r in coded.select("round_trip").collect())
    decoded = sentencepiece_nbest.decode_ids(coded.selectExpr("doc_id", "nbest[0].ids ids"))
    same([(r["doc_id"], r["text"]) for r in decoded.collect()], texts_by_row(docs))


# all of them


@pytest.mark.parametrize(
    "operator",
    [
        lm_scoring.lm_scores,
        license_scan.license_scan,
        simhash.simhash_groups,
        sentencepiece_nbest.encode_nbest,
        quality_rules.quality_rules,
        packing.pack,
        secret_scan.secret_scan,
    ],
)
def test_empty_tables(none, operator):
    assert operator(none).collect() == []


@pytest.mark.parametrize("operator", [license_scan.license_scan, secret_scan.secret_scan, quality_rules.quality_rules])
def test_one_row_for_each_row(docs, operator):
    assert operator(docs).count() == docs.count()


def test_empty_vectors_and_labels(spark, none):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.quality_classifier(none, labels).collect() == []
