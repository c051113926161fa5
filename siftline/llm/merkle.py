"""Operator 13, a Merkle manifest of a dataset by superblock reduction.

Each row is a leaf: the SHA-256 of its columns. A source's leaves, in the order of their ids, are the first
level of a tree: every ``FANOUT`` = 16 consecutive nodes become the hash of their hashes' text, until one
is left, the source's subroot. Subroots, in the order of sources, are the leaves of the tree above.

Levels are not built one at a time. Nodes are grouped by superblocks of FANOUT ** ``LEVELS`` consecutive
ones, each of which collapses LEVELS levels at once in a task of its own; the roots of the superblocks
are the nodes of the next round, so rounds grow with the logarithm to the base 256. Proofs come down the same way:
a superblock's nodes meet the proof of its root, and each node's siblings within the superblock are put
before it. No task sees more than a superblock; nothing but a count reaches the driver.

A superblock needs no size of its tree: any but the first is within a tree of more nodes, and the
first, if it isn't full, is the whole tree, which collapses until one node is left. A full one does
either way.

Defined results: null columns count as ``-``. A null id comes first, and is never tampered with, for it has no decimal
text. Equal ids follow by their leaves' hashes, equal rows by chance, which no column of the result shows. A null source is a
source of its own, before all others, and no other than the empty one. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.windows import row_numbers

from .common import begin, stored

FANOUT = 16
LEVELS = 2
BLOCK = FANOUT**LEVELS
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A tampered row is one whose id's crc32 this divides.
TAMPERED = 5

NODE = "tree string, idx long, hash string"
#: ``siblings`` has the hashes beside the path, level by level from left to right; ``positions`` and ``sizes`` are of the
#: path's node in its run and of that run, a pair for each level.
PATH = "subroot string, root string, siblings string, positions array<int>, sizes array<int>"


def hash_of(columns: list[Column]) -> Column:
    """A row's leaf: each value as its size in bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*sized).cast("binary"), 256)


def lower_case(text: Column) -> Column:
    """A-Z alone become a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, the leaf's hash, and ``forged``: the leaf of the tampered row, null where it isn't tampered with."""
    columns = {c: F.col(c) for c in COLUMNS}
    chosen = F.crc32(columns["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    forged = hash_of([*(columns[c] for c in COLUMNS[:-1]), lower_case(columns["text"].cast("string"))])
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # in the order of sources, null first
    return docs.select("doc_id", tree.alias("tree"), hash_of(list(columns.values())).alias("hash"), F.when(chosen, forged).alias("forged"))


def runs(nodes: list[str]) -> Iterator[list[str]]:
    for at in range(0, len(nodes), FANOUT):
        yield nodes[at : at + FANOUT]


def collapsed(nodes: list[str], block: int) -> list[list[str]]:
    """A superblock's nodes level by level, up to its root."""
    levels = [nodes]
    whole = block == 0 and len(nodes) < BLOCK
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        levels.append([hashlib.sha256("".join(run).encode()).hexdigest() for run in runs(levels[-1])])
    return levels


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of nodes (tree, idx, hash): those given, the roots of their superblocks, and so on to one node a tree."""

    def root_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        begin(__name__)
        tree, block = key
        hashes = frame.sort_values("idx")["hash"].tolist()
        return pd.DataFrame({"tree": [tree], "idx": [block], "hash": collapsed(hashes, block)[-1]})

    rounds = [nodes]
    while rounds[-1].agg(F.max("idx")).first()[0]:
        blocks = rounds[-1].select("tree", "idx", "hash").groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block"))
        rounds.append(stored(blocks.applyInPandas(root_of, NODE), "superblocks"))
    return rounds


def proven(nodes: DataFrame, above: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Each node with the proof up to the root. ``above`` has the proofs of the superblocks, by (tree, idx)."""
    keep = list(keep)
    names = [*keep, "tree", "idx", "hash", "subroot", "root", "siblings", "positions", "sizes"]

    def paths(key: tuple, frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        begin(__name__)
        if frame.empty:
            return pd.DataFrame(columns=names)
        frame = frame.sort_values("idx")
        upper = upper.iloc[0]
        siblings: list[list[str]] = [[] for _ in range(len(frame))]
        positions: list[list[int]] = [[] for _ in siblings]
        sizes: list[list[int]] = [[] for _ in siblings]
        span = 1
        for level in collapsed(frame["hash"].tolist(), key[1])[:-1]:
            for k in range(len(siblings)):
                at = k // span
                first = at - at % FANOUT
                run = level[first : first + FANOUT]
                siblings[k] += run[: at - first] + run[at - first + 1 :]
                positions[k].append(at - first)
                sizes[k].append(len(run))
            span *= FANOUT
        return frame.assign(
            subroot=upper["subroot"],
            root=upper["root"],
            siblings=["".join(x) + upper["siblings"] for x in siblings],
            positions=[[*x, *upper["positions"]] for x in positions],
            sizes=[[*x, *upper["sizes"]] for x in sizes],
        )[names]

    schema = ", ".join([*(f"{c} string" for c in keep), NODE, PATH])
    blocks = nodes.select(*keep, "tree", "idx", "hash").groupBy("tree", F.expr(f"idx div {BLOCK}"))
    return blocks.cogroup(above.groupBy("tree", "idx")).applyInPandas(paths, schema)


def all_proven(rounds: list[DataFrame], above: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Proofs from the last round down to the first, whose nodes keep columns of their own."""
    for nodes in rounds[:0:-1]:
        above = stored(proven(nodes, above).drop("hash"), "proofs")
    return proven(rounds[0], above, keep)


def folded(leaf: Column) -> Column:
    """The root that a leaf and the proof beside it give; only columns are needed, neither the tree nor other rows."""
    start = F.struct(leaf.alias("hash"), F.lit(1).alias("at"))

    def step(done: Column, level: Column) -> Column:
        before, after = 64 * level["positions"], 64 * (level["sizes"] - level["positions"] - 1)
        siblings = F.col("siblings")
        run = F.concat(siblings.substr(done["at"], before), done["hash"], siblings.substr(done["at"] + before, after))
        return F.struct(F.sha2(run.cast("binary"), 256).alias("hash"), (done["at"] + before + after).alias("at"))

    return F.aggregate(F.arrays_zip("positions", "sizes"), start, step, lambda done: done["hash"])


def merkle_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, forged, subroot, root, siblings, positions, sizes: a row for each row of ``docs``."""
    marked = row_numbers(leaves(docs), ["doc_id", "hash"], ["tree"])
    kind = docs.schema["doc_id"].dataType
    # ids go as text, for pandas would make numbers with nulls among them inexact
    marked = marked.select(F.col("doc_id").cast("string").alias("doc_id"), "forged", "tree", (F.col("__n") - 1).alias("idx"), "hash")
    rounds = reduced(stored(marked, "leaves"))
    subroots = rounds[-1].select("tree", F.col("hash").alias("subroot"))
    ordered = row_numbers(subroots, ["tree"]).select(F.lit("").alias("tree"), (F.col("__n") - 1).alias("idx"), F.col("subroot").alias("hash"), F.col("tree").alias("source"))
    top = reduced(stored(ordered, "subroots"))
    none = F.array().cast("array<int>")
    root = top[-1].select("tree", "idx", F.lit("").alias("subroot"), F.col("hash").alias("root"), F.lit("").alias("siblings"), none.alias("positions"), none.alias("sizes"))
    sources = all_proven(top, root, ["source"]).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("hash").alias("subroot"), "root", "siblings", "positions", "sizes")
    found = all_proven(rounds, stored(sources, "proofs"), ["doc_id", "forged"])
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("hash").alias("leaf"), "forged", "subroot", "root", "siblings", "positions", "sizes")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, a digest of its proof, and whether the proof holds for the row, tampered or not."""
    proofs = merkle_proofs(docs)
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("forged", "leaf")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in DuckDB, a level at a time; the checksum goes bit by bit.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN length(CAST(doc_id AS VARCHAR)) > 0 THEN xor(list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_transform(range(0, 8), lambda j: (ord(CAST(doc_id AS VARCHAR)[i]) >> j) & 1))),
    lambda c, b: xor(xor(c, b::BIGINT) >> 1, 3988292384::BIGINT * (xor(c, b::BIGINT) & 1))), 4294967295::BIGINT) % 5 = 0 ELSE false END AS tampered FROM documents),
  h AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered FROM d),
  l AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN tampered THEN lowered ELSE body END) AS shown FROM h),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
  s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM o GROUP BY source),
  low(level, tree, i, hash, n) AS (SELECT 0, tree, i, leaf, s.n FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source
    UNION ALL SELECT level + 1, tree, i // 16, sha256(string_agg(hash, '' ORDER BY i)), (max(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY level, tree, i // 16),
  sub AS (SELECT tree, hash AS subroot FROM low WHERE n = 1),
  high(level, i, hash, n) AS (SELECT 0, tree, subroot, (SELECT count(*) FROM s) FROM sub
    UNION ALL SELECT level + 1, i // 16, sha256(string_agg(hash, '' ORDER BY i)), (max(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY level, i // 16),
  runs AS (SELECT false AS top, tree, level, i, n = 1 AS up, string_agg(hash, '') OVER (PARTITION BY tree, level, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      string_agg(hash, '') OVER (PARTITION BY tree, level, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM low
    UNION ALL SELECT true, 0, level, i, false, string_agg(hash, '') OVER (PARTITION BY level, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      string_agg(hash, '') OVER (PARTITION BY level, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) FROM high WHERE n > 1),
  walk(doc_id, leaf, tree, top, level, i, hash, proof) AS (SELECT doc_id, leaf, s.tree, false, 0, o.i, shown, '' FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source
    UNION ALL SELECT doc_id, leaf, walk.tree, walk.top OR r.up, CASE WHEN r.up THEN 0 ELSE walk.level + 1 END, CASE WHEN r.up THEN walk.tree ELSE walk.i // 16 END,
      CASE WHEN r.up THEN walk.hash ELSE sha256(coalesce(r.before, '') || walk.hash || coalesce(r.after, '')) END,
      CASE WHEN r.up THEN proof ELSE proof || coalesce(r.before, '') || coalesce(r.after, '') END
    FROM walk JOIN runs r ON r.top = walk.top AND r.level = walk.level AND r.i = walk.i AND (walk.top OR r.tree = walk.tree))
SELECT doc_id, leaf, subroot, high.hash AS root, sha256(proof) AS proof_sha256, walk.hash AS folded_root, walk.hash = high.hash AS verified
FROM walk JOIN sub ON sub.tree = walk.tree JOIN high ON high.n = 1
WHERE walk.top AND walk.level = high.level
"""
