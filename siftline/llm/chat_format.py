"""Operator 3, chat formatting: cumulative snapshots are collapsed before rendering.

Services log a conversation again after every turn. A conversation that is a prefix of a longer one, or
equal to one with a smaller id, is dropped; what is maximal is rendered. Prefixes are told by rolling
hashes: the exclusive-or of 2 x 64 bits of each turn's place, role and text, so that the hash of a prefix
is one column beside its last turn. An anti-join of whole conversations with the distinct prefix
hashes of longer ones leaves the maximal ones.

No conversation is gathered in one task: turns are sorted by range, numbered and hashed within the part of a
conversation that a range holds, and parts are put together by a window over one row a part. Repeated
turns and turns without a number or an id are dealt out like any others. A conversation is rendered in
parts of ``PART`` turns.

Defined results: turns are ordered by number (null last), role and text; repeated rows are turns of their
own. A null role or text is an empty one. Rows with a null conv_id are one conversation. A table without
rows gives none. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

PART = 256


#: What a conversation is known by: its id, and whether it has none. Null ids would meet in no join.
CONV = ["conv", "unnamed"]
#: How many bits of a row's number tell its place within a partition.
PLACE_BITS = 33


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv, unnamed, place, role, text, h1, h2): each turn with its place from 1 and the hash of all turns up to it."""
    spark = conversations.sparkSession
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("unnamed"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # equal rows differ by their number alone, so that a range may end among them
    order = [*CONV, F.asc_nulls_last("turn"), "role", "text", "row"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    sorted_turns = stored(ranged.select(*CONV, "role", "text", F.monotonically_increasing_id().alias("at")), "sorted-turns")
    turns = sorted_turns.select(
        *CONV, "role", "text", F.shiftright("at", PLACE_BITS).alias("block"), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("at")
    )
    before = W.partitionBy(*CONV).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = turns.groupBy(*CONV, "block").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    offsets = sizes.select(*CONV, "block", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = turns.join(offsets, [*CONV, "block"]).withColumn("local", F.col("at") - F.col("first") + 1)
    hashed = placed.select(*CONV, "block", (F.col("local") + F.col("offset")).alias("place"), "role", "text").select(
        "*",
        F.xxhash64(F.lit("a"), "place", "role", "text").alias("x1"),
        F.xxhash64(F.lit("b"), "text", "role", "place").alias("x2"),
    )
    running = W.partitionBy(*CONV, "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    local = hashed.withColumn("l1", F.bit_xor("x1").over(running)).withColumn("l2", F.bit_xor("x2").over(running))
    totals = hashed.groupBy(*CONV, "block").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    starts = totals.select(
        *CONV,
        "block",
        F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("b2"),
    )
    return local.join(starts, [*CONV, "block"]).select(
        *CONV, "place", "role", "text", F.expr("l1 ^ b1").alias("h1"), F.expr("l2 ^ b2").alias("h2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, unnamed, n_turns, n_copies) of conversations that are no proper prefix of another; one of equal ones.

    Of equal conversations the smallest id stays, one without an id only if none has one.
    """
    ends = turns.groupBy(*CONV).agg(F.max("place").alias("n_turns"))
    hashes = turns.select(*CONV, "place", "h1", "h2").join(ends, CONV)
    whole = hashes.filter("place = n_turns").groupBy("n_turns", "h1", "h2")
    distinct = whole.agg(F.min(F.struct("unnamed", "conv")).alias("least"), F.count("*").alias("n_copies"))
    longer = hashes.filter("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    kept = distinct.join(longer, ["n_turns", "h1", "h2"], "left_anti")
    return kept.select("least.conv", "least.unnamed", "n_turns", "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): maximal conversations as marked-up text, ``PART`` turns a row."""
    turns = stored(prefixes(conversations), "turns")
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    mine = turns.join(maximal(turns), CONV).select(
        F.when(~F.col("unnamed"), F.col("conv")).alias("conv_id"),
        F.floor((F.col("place") - 1) / PART).alias("part"),
        "n_turns",
        "n_copies",
        "place",
        line.alias("line"),
    )
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return mine.groupBy("conv_id", "part", "n_turns", "n_copies").agg(text.alias("text"))


#: The same in DuckDB's SQL: conversations as lists, compared by their beginnings.
ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM conversations),
  c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY place) AS turns FROM t GROUP BY conv_id),
  d AS (SELECT min(conv_id) AS conv_id, turns, CAST(len(turns) AS BIGINT) AS n_turns, count(*) AS n_copies FROM c GROUP BY turns),
  k AS (SELECT * FROM d WHERE NOT EXISTS
    (SELECT 1 FROM d x WHERE x.n_turns > d.n_turns AND x.turns[1] = d.turns[1] AND list_slice(x.turns, 1, d.n_turns) = d.turns))
SELECT k.conv_id, (place - 1) // 256 AS part, n_turns, n_copies,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL
"""
