"""Operator 12, collocations by Apriori passes over the levels of phrases.

Level k counts phrases of k words. A pass over the texts emits a phrase of k words only where both phrases of
k - 1 words in it, which overlap, are frequent by the level before. A phrase can't be more frequent than its parts, so
nothing frequent is lost. Then candidates are cut into two parts, whose frequencies stand in the level tables, and scored.

What a pass must know of the level before is broadcast as a bitmap of ``BITMAP_BITS`` bits, in which each frequent
phrase sets the one of its hash. Its size is fixed, however many phrases are frequent; a phrase that is let through
by a bit of another is counted in full like any other and fails by its own count, so results
are exact at any fill. Phrases are counted by their words, never by hashes: in a task once a batch, then by Spark.

No key holds more rows than there are batches, since batches count before rows are shuffled, and languages are never
grouped whole: candidates are ranked by ranges of language and score.

Defined results: a null text is empty, a null language ``und``. Texts without words, and languages without candidates,
have no rows. Repeated rows count as often as they stand. Phrases never cross the end of a piece or a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.windows import row_numbers

from .common import as_bytes, as_text, in_batches, stored

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: A candidate goes if a longer one around it has at least this share of its occurrences, in percent.
CONTAINED = 80
SCALE = 2_000_000
BITMAP_BITS = 1 << 27
NO_LANG = "und"
#: So many phrases leave a task at a time.
OUT_ROWS = 1 << 18

#: A-Z become lower, ends of pieces line feeds, tabs spaces.
PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
LEVEL = "lang string, phrase string, n long"


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of texts as numbers, and the words by number; 0 is the end of a piece. All texts at once, byte by byte."""
    data = np.frombuffer(b"\n" + b"\n".join(texts).translate(PLAIN), np.uint8)
    used, end = data != 32, data == 10
    starts = used.copy()
    starts[1:] &= ~used[:-1] | end[1:] | end[:-1]
    packed, places = data[used], np.flatnonzero(starts[used])
    offsets = np.append(places, len(packed)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_utf8(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    known = words.dictionary_encode()
    return known.indices.to_numpy(), known.dictionary.cast(pa.string())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_bits(lang: str, hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The bits of the phrases of ``size`` words that start at these places of the words' hashes."""
    mixed = np.full(len(starts), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return (mixed % np.uint64(BITMAP_BITS)).astype(np.int64)


def held(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0


def counted(lang: str, texts: list[bytes], size: int, bitmap: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The phrases of ``size`` words in some texts whose parts are in the bitmap, and how often each stands there.

    For single words all, and null for the number of words.
    """
    ids, words = words_of(texts)
    if size == 1:
        found = np.bincount(ids, minlength=len(words))
        found[0] = len(ids) - found[0]
        yield pa.concat_arrays([pa.nulls(1, pa.string()), words[1:]]), found
        return
    here = max(len(ids) - size + 2, 0)
    inside = ids[:here] > 0  # a phrase of size - 1 words starts here
    for k in range(1, size - 1):
        inside = inside & (ids[k : here + k] > 0)
    starts = np.flatnonzero(inside)
    frequent = np.zeros(here, bool)
    frequent[starts[held(bitmap, gram_bits(lang, word_hashes(as_bytes(words))[ids], starts, size - 1))]] = True
    starts = np.flatnonzero(frequent[:-1] & frequent[1:])
    place = ids[starts].astype(np.int64)
    for k in range(1, size):  # equal phrases get equal numbers, exactly
        numbered = pa.array(place * len(words) + ids[starts + k]).dictionary_encode()
        place = numbered.indices.to_numpy().astype(np.int64)
    at = np.zeros(len(numbered.dictionary), np.int64)
    at[place] = starts  # one place of each phrase
    total = np.bincount(place, minlength=len(at))
    for k in range(0, len(at), OUT_ROWS):
        some = at[k : k + OUT_ROWS]
        yield pc.binary_join_element_wise(*(words.take(pa.array(ids[some + j])) for j in range(size)), " "), total[k : k + OUT_ROWS]


def level(docs: DataFrame, size: int, bitmap: Broadcast | None) -> DataFrame:
    """(lang, phrase, n) of all phrases of ``size`` words that the level before lets through."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(as_text(batch.column(0)), as_bytes(batch.column(1)), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for phrases, n in counted(lang, texts, size, bitmap.value if bitmap else None):
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    return in_batches(given, rows, LEVEL, __name__).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap_of(phrases: DataFrame, size: int) -> Broadcast:
    """The bits of a level's phrases, gathered as words of 64, of which there are BITMAP_BITS / 64 at most."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.empty(batch.num_rows, np.int64)
        langs = np.array(as_text(batch.column(0)), object)
        split = [x.split(b" ") for x in as_bytes(batch.column(1))]
        for lang in set(langs):
            mine = (langs == lang).nonzero()[0]
            hashes = word_hashes([w for k in mine.tolist() for w in split[k]])
            bits[mine] = gram_bits(lang, hashes, np.arange(len(mine)) * size, size)
        return pa.RecordBatch.from_arrays([pa.array(bits)], names=["bit"])

    bits = in_batches(phrases.select("lang", "phrase"), rows, "bit long", __name__)
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("word"))
    found = words.toArrow()
    bitmap = np.zeros(BITMAP_BITS >> 6, np.uint64)
    bitmap[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bitmap)


def levels(docs: DataFrame, most_words: int = MAX_WORDS, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(size, lang, phrase, n) of all phrases that stand ``least`` times or more; and (lang, n) with the number of words."""
    first = stored(level(docs, 1, None).filter(f"n >= {least} or phrase is null"), "level")
    totals = first.filter("phrase is null").select("lang", "n")
    tables = [first.filter("phrase is not null")]
    for size in range(2, most_words + 1):
        bitmap = bitmap_of(tables[-1], size - 1)
        tables.append(stored(level(docs, size, bitmap).filter(f"n >= {least}"), "level"))
        bitmap.unpersist()
    found = tables[0].select(F.lit(1).alias("size"), "lang", "phrase", "n")
    for size, part in enumerate(tables[1:], 2):
        found = found.unionByName(part.select(F.lit(size).alias("size"), "lang", "phrase", "n"))
    return found, totals


def parts_within(least: int) -> str:
    """All contiguous parts of a phrase of ``least`` words or more that are shorter than it."""
    return f"flatten(transform(sequence({least}, size - 1), m -> transform(sequence(1, size - m + 1), at -> array_join(slice(words, at, m), ' '))))"


def scored(found: DataFrame) -> DataFrame:
    """Candidates with the cut of the lowest score: lang, phrase, size, a, l, r, score. ``found`` is the level tables."""
    candidates = found.filter("size > 1").withColumnRenamed("n", "a")
    cut = candidates.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cut = cut.selectExpr("*", "substring_index(phrase, ' ', k) head", "substring_index(phrase, ' ', k - size) tail")
    heads = found.selectExpr("lang", "phrase head", "n l")
    tails = found.selectExpr("lang", "phrase tail", "n r")
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    whole = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = whole.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def standing_alone(candidates: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """Candidates without those that mostly stand inside a longer one."""
    longer = candidates.filter("size > 2").withColumn("words", F.split("phrase", " "))
    within = longer.select("lang", F.explode(F.expr(parts_within(2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    covered = F.expr(f"cast(around as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {percent}")
    return candidates.join(within, ["lang", "phrase"], "left").filter(F.col("around").isNull() | ~covered).drop("around")


def collocations(docs: DataFrame, top: int = TOP, most_words: int = MAX_WORDS, least: int = MIN_COUNT, percent: int = CONTAINED) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, totals = levels(docs, most_words, least)
    alone = standing_alone(scored(found), percent)
    falling = alone.selectExpr("*", "-score low", "-a rare")
    best = row_numbers(falling, ["low", "rare", "phrase"], ["lang"]).filter(F.col("__n") <= top)
    return best.join(totals, "lang").select("lang", F.col("__n").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB: every phrase counted, nothing pruned.
ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
  g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS m))),
  f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
  t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
  c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND n >= {MIN_COUNT}),
  k AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
  s AS (SELECT k.lang, k.m, k.phrase, a, k, h.n AS l, e.n AS r, CAST({SCALE}::HUGEINT * a // (h.n + e.n) AS BIGINT) AS score FROM k
    JOIN f h ON h.lang = k.lang AND h.phrase = head JOIN f e ON e.lang = k.lang AND e.phrase = tail),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  x AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, array_to_string(ws[i : i + z - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM c, (SELECT unnest(range(2, {MAX_WORDS})) AS z) WHERE z < m)) GROUP BY ALL),
  o AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE around IS NULL OR 100::HUGEINT * around < {CONTAINED}::HUGEINT * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank, o.phrase, a, l, r, t.n, score
FROM o JOIN t ON t.lang = o.lang QUALIFY rank <= {TOP}
"""
