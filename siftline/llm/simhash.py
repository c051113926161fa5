"""Operator 4, SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit for each place where over half of the text's shingle hashes have one. Two
texts are linked if their fingerprints differ at ``MAX_DISTANCE`` = 3 bits at most. Cut into two halves,
one half of such a pair differs at one bit at most. So each distinct fingerprint is indexed under each
half as it is, and under each half with one bit replaced by a wildcard (33 keys a half); linked
fingerprints meet at a key of either kind, are joined there on equality, and verified on all 64 bits.

Rows never meet pair by pair where a key is frequent. Equal fingerprints are one row before any join.
A wildcard key joins those with a zero at the wildcard to those with a one only. Where a half is
shared by many fingerprints, the pairs differ in the other half alone, at up to three bits, and the
same scheme is used again on it: see ``links``.

Defined results: a null or blank text has no words and the fingerprint zero, which is linked like any
other; fewer words than a shingle make one shingle. Repeated rows and repeated ids give a row each. A
null doc_id keeps its row; it never names a component unless every reachable id is null.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_bytes, per_text, stored
from .components import BROADCAST_LINKS, components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = text.lower().split()
    n = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    if n < 1:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes).tolist()
        stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
        shingles = [line[a:b] for a, b in zip(starts, stops)]  # noqa: B905  starts has two more
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.dtype("<u8"), len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a block at a time: each hash becomes 64 bytes
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


#: A key that more fingerprints share than this is cut further by the other half.
HOT_KEY = 200
#: So many frequent keys (of eight bytes each) at most are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 50_000


def fingerprints(docs: DataFrame, carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``bits``, the fingerprint as a signed long."""

    def rows(texts):
        for text in as_bytes(texts):
            value = fingerprint(text)
            yield (value - (value >> 63 << 64),)

    return per_text(docs, [("bits", "long")], rows, carry)


def halves(bits: DataFrame) -> DataFrame:
    """(bits, which, half, other): each fingerprint under its low half (0) and its high half (1)."""
    return (
        bits.selectExpr("bits", "bits & 4294967295L low", "shiftrightunsigned(bits, 32) high")
        .select("bits", F.explode(F.expr("array(named_struct('which', 0L, 'half', low, 'other', high), named_struct('which', 1L, 'half', high, 'other', low))")).alias("h"))
        .select("bits", "h.which", "h.half", "h.other")
    )


#: A key packs (33 * which + place) and the half, its bit at the wildcard's place cleared, into one long, without loss.
#: Place 32 stands for no wildcard.
KEY = "shiftleft(33 * which + place, 32) + if(place = 32, half, half & ~shiftleft(1L, int(place)))"
#: For a frequent key: the bytes of the other half, one of which must agree, for the pair differs there at three bits at most.
QUARTERS = "array(0L, 1L, 2L, 3L)"


def keys(split: DataFrame, bit: int) -> DataFrame:
    """(key, bits, other) for no wildcard, and for the wildcards at whose place the half has ``bit``."""
    places = F.explode(F.expr("sequence(0L, 32L)")).alias("place")
    found = split.select("bits", "which", "half", "other", places)
    return found.filter(f"place = 32 or (shiftright(half, int(place)) & 1L) = {bit}").selectExpr(f"{KEY} key", "bits", "other")


def frequent_keys(split: DataFrame) -> DataFrame:
    """Keys that more than HOT_KEY fingerprints may share. A wildcard joins two halves: one of them has half of the rows."""
    often = split.groupBy("which", "half").count().filter(F.col("count") > HOT_KEY // 2)
    return often.select("which", "half", F.explode(F.expr("sequence(0L, 32L)")).alias("place")).selectExpr(f"{KEY} key").distinct()


def links(bits: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ at MAX_DISTANCE bits or fewer. ``bits`` has distinct rows.

    Spark doesn't know that a fingerprint becomes some 35 keys and would broadcast them by the size of one; both sides are shuffled.
    """
    spark = bits.sparkSession
    split = halves(bits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bits"))
    hot = stored(frequent_keys(split), "frequent-keys")
    n_hot = hot.count()
    left, right = keys(split, 0), keys(split, 1)
    on = ["key"]
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot.hint("merge")
        flagged = few.withColumn("hot", F.lit(True))
        quarter = F.explode(F.when(F.col("hot"), F.expr(QUARTERS)).otherwise(F.expr("array(4L)"))).alias("quarter")
        byte = F.expr("if(quarter = 4, 0L, shiftright(other, int(8 * quarter)) & 255L)").alias("byte")
        left, right = (
            x.join(flagged, "key", "left").select("key", "bits", "other", quarter).select("key", "bits", "quarter", byte)
            for x in (left, right)
        )
        on += ["quarter", "byte"]
    near = F.expr(f"bit_count(a ^ b) <= {MAX_DISTANCE} and (shiftright(key, 32) % 33 < 32 or a < b)")
    pairs = left.select(*on, F.col("bits").alias("a")).join(right.select(*on, F.col("bits").alias("b")).hint("merge"), on)
    return pairs.filter(near).select("a", "b").distinct()


def as_hex(bits: Column) -> Column:
    """16 lower-case digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Its joins are shuffles, for sizes guessed from compressed files would broadcast a row for every fingerprint; only where few have a
    link their components are broadcast, so that a large one isn't one task.
    """
    marked = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "fingerprints")
    distinct = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("bits"))).withColumnRenamed("node", "bits")
    linked = stored(distinct.join(roots.hint("merge"), "bits"), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = F.broadcast(named) if linked.count() <= BROADCAST_LINKS else named.hint("merge")
    of = linked.join(named, "root").select("bits", "component_id")
    of = distinct.join(of.hint("merge"), "bits", "left").select("bits", F.coalesce("component_id", "least").alias("component_id"))
    of = stored(of, "components")  # read again, so that Spark can split a fingerprint that very many rows have
    return marked.join(of.hint("merge"), "bits").select("doc_id", as_hex(F.col("bits")).alias("fingerprint"), "component_id")
