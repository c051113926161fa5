"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and an equality join on edges, so no node, link or component list is
ever held by the driver or one task; rounds grow with the logarithm of the longest path. What a round
leaves is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60
#: With so many links at most, what their nodes are linked to is broadcast (32 bytes a node); with more it is joined by a shuffle.
#: Links are counted, for the size of a compressed file says too little.
BROADCAST_LINKS = 100_000


def digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with what ``least`` has for their a, if there are ``n`` links."""
    return edges.join(F.broadcast(least) if n <= BROADCAST_LINKS else least.hint("merge"), "a")


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of the node's neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return with_least(both, least, n).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them. Edges point from greater to lesser."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = with_least(edges, least, n).filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the least node reachable.

    ``links`` has long columns a and b, either way round; nulls and loops count for nothing.
    """
    edges = links.filter("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = digest(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = stored(small_star(large_star(edges, before[0]), before[0]), "star")
        after = digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", "node"))
