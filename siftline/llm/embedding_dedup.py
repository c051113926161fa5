"""Operator 5, embedding near-duplicates by int8 tile products with error bounds.

Unit vectors are quantised to int8 codes; a vector's error is the length of what its code leaves out.
For two vectors with codes p, q and errors d, e the cosine lies within d + e + d*e of the codes'
product (Cauchy-Schwarz), so most pairs are decided by integer products of tiles alone: surely below
the threshold, or surely linked. The pairs between are computed by second codes, of what the first leave
out, with bounds about a hundred times as narrow; only what is open then is computed again, from the full
vectors in double precision.

Work is dealt in tiles: vectors of a label are cut into blocks of about ``BLOCK`` and every pair of
blocks is one group, so a label that holds a third of all rows becomes many groups of bounded size.
Equal vectors of a label are one class with a count before any tile. A tile returns link counts by
class and a star of each component of its sure links, not its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing (n_links 0, component_id their own id, kept). Vectors of
different lengths don't link. Repeated rows are other vectors: they link with each other. A null
vec_id keeps its row and never names a component unless all reachable ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, stored
from .components import components

THRESHOLD = 0.93
BLOCK = 2048
#: For the rounding of single steps in double and float32; far above it, far below any error of a code.
SLACK = 1e-6


def quantised(batches):
    """Arrow batches (class_id, label, dim, n, embedding) -> the same with codes of the unit vector for the embedding.

    code, scale: the vector in int8; fine, fine_scale: what that leaves out, in int8 again; error, fine_error: the lengths
    of what is left out then.
    """
    begin(__name__)
    names = ["class_id", "label", "dim", "n", "code", "scale", "error", "fine", "fine_scale", "fine_error"]
    for batch in batches:
        rows = batch.to_pydict()
        made = []
        for values in rows["embedding"]:
            x = np.asarray(values, np.float64)
            x = x / np.abs(x).max()  # no overflow of the squares
            x = x / np.sqrt(x @ x)
            row = []
            for _ in range(2):
                scale = float(np.abs(x).max()) / 127 or 1.0
                code = np.rint(x / scale)
                x = x - scale * code
                row += [code.astype(np.int8).tobytes(), scale, float(np.sqrt(x @ x)) + SLACK]
            made.append(row)
        columns = list(zip(*made, strict=True)) or [()] * 6
        kinds = [pa.binary(), pa.float64(), pa.float64()] * 2
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *arrays], names=names)


#: So many pairs of a tile at a time are computed by fine codes.
PAIRS = 65_536


def refined(r: np.ndarray, c: np.ndarray, vectors: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(surely linked, perhaps linked) of pairs of places, by vectors of both codes and their errors."""
    sure, maybe = np.zeros(len(r), bool), np.zeros(len(r), bool)
    for at in range(0, len(r), PAIRS):
        x, y = r[at : at + PAIRS], c[at : at + PAIRS]
        about = np.einsum("ij,ij->i", vectors[x], vectors[y])
        off = error[x] + error[y] + error[x] * error[y]
        sure[at : at + PAIRS] = about - off >= THRESHOLD
        maybe[at : at + PAIRS] = about + off >= THRESHOLD
    return sure, maybe & ~sure


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of a boolean tile: (first row, whether the other is a column, the other's place) as a star for each.

    Whole rows and columns are read at once, each of them once, however many links there are.
    """
    new_row, new_column = linked.any(1), linked.any(0)
    out: list[tuple[int, bool, int]] = []
    for first in range(len(linked)):
        if not new_row[first]:
            continue
        new_row[first] = False
        rows = np.array([first])
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(0) & new_column)
            new_column[columns] = False
            out += [(first, True, k) for k in columns.tolist()]
            rows = np.flatnonzero(linked[:, columns].any(1) & new_row) if len(columns) else columns
            new_row[rows] = False
            out += [(first, False, k) for k in rows.tolist()]
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1].astype(bool), found[:, 2]


def tile(table: pa.Table) -> pa.Table:
    """Links of one tile: rows (a, b, kind, n).

    kind 0: a pair to compute again; 1: an edge of the sure links' forest; 2: a is surely linked with n vectors (b null).
    """
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block = table.column("block").to_numpy()
    ids, n = table.column("class_id").to_numpy(), table.column("n").to_numpy()
    d = table.column("dim")[0].as_py()
    code, fine = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int8).reshape(-1, d) for c in ("code", "fine"))
    kind = np.float32 if d * 127 * 127 < 1 << 24 else np.float64  # the products are whole numbers, exact in either
    scale, error, fine_scale, fine_error = (table.column(c).to_numpy() for c in ("scale", "error", "fine_scale", "fine_error"))
    vectors = scale[:, None] * code + fine_scale[:, None] * fine
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    linked = np.zeros((len(one), len(two)), bool)
    open_a, open_b = [], []
    codes_two = code[two].astype(kind).T
    for at in range(0, len(one), 256):
        rows = one[at : at + 256]
        about = (code[rows].astype(kind) @ codes_two).astype(np.float64) * np.outer(scale[rows], scale[two])
        off = error[rows][:, None] + error[two][None, :] + np.outer(error[rows], error[two])
        if i == j:
            about[np.arange(at, at + len(rows))[:, None] >= np.arange(len(two))[None, :]] = -9.0
        sure = about - off >= THRESHOLD
        r, c = np.nonzero((about + off >= THRESHOLD) & ~sure)
        also, still = refined(rows[r], two[c], vectors, fine_error)
        sure[r[also], c[also]] = True
        linked[at : at + len(rows)] = sure
        open_a.append(ids[rows[r[still]]])
        open_b.append(ids[two[c[still]]])
    others = np.zeros(len(ids), np.int64)
    others[one] += linked @ n[two]
    others[two] += n[one] @ linked
    if i == j:  # each vector is a row and a column
        linked |= linked.T
        np.fill_diagonal(linked, linked.any(1))
    first, is_column, place = stars(linked)
    root, leaf = ids[one[first]], np.where(is_column, ids[two[np.where(is_column, place, 0)]], ids[one[np.where(is_column, 0, place)]])
    root, leaf = root[root != leaf], leaf[root != leaf]
    counted = np.flatnonzero(others)
    a = np.concatenate([*open_a, root, ids[counted]]).astype(np.int64)
    b = np.concatenate([*open_b, leaf, ids[counted]]).astype(np.int64)
    pairs = sum(map(len, open_a))
    kinds = np.repeat([0, 1, 2], [pairs, len(root), len(counted)]).astype(np.int32)
    amount = np.concatenate([np.zeros(pairs + len(root), np.int64), others[counted]])
    return pa.table({"a": a, "b": b, "kind": kinds, "n": amount})


def cosine(x: str, y: str):
    """Of two array columns, scaled to a largest component of 1, in double precision, in the JVM."""

    def dot(u: str, v: str) -> str:
        return f"aggregate(zip_with({u}, {v}, (p, q) -> p * q), 0d, (s, t) -> s + t)"

    return F.expr(f"{dot(x, y)} / sqrt({dot(x, x)}) / sqrt({dot(y, y)})")


def embedding_groups(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    whole = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        & F.expr("exists(embedding, x -> x <> 0)")
    )
    given = given.withColumn("whole", F.coalesce(whole, F.lit(False)))
    classes = given.filter("whole").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = classes.withColumn("dim", F.size("embedding")).withColumn("class_id", F.monotonically_increasing_id())
    classes = stored(classes, "vector-classes")

    label_type = classes.schema["label"].dataType.simpleString()
    codes = classes.select("class_id", "label", "dim", "n", "embedding").mapInArrow(
        quantised, f"class_id long, label {label_type}, dim int, n long, code binary, scale double, error double, fine binary, fine_scale double, fine_error double"
    )
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        codes.join(blocks, ["label", "dim"])
        .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    found = dealt.groupBy("label", "dim", "i", "j").applyInArrow(tile, "a long, b long, kind int, n long")
    found = stored(found, "tiles")

    peaks = classes.withColumn("peak", F.expr("array_max(transform(embedding, p -> abs(p)))"))
    full = peaks.select("class_id", "n", F.expr("transform(embedding, p -> p / peak)").alias("embedding"))
    again = (
        found.filter("kind = 0")
        .join(full.selectExpr("class_id a", "n na", "embedding x"), "a")
        .join(full.selectExpr("class_id b", "n nb", "embedding y"), "b")
        .filter(cosine("x", "y") >= THRESHOLD)
        .select("a", "b", "na", "nb")
    )
    again = stored(again, "recomputed")
    counts = (
        found.filter("kind = 2").select(F.col("a").alias("class_id"), "n")
        .union(again.select("a", "nb")).union(again.select("b", "na"))
        .groupBy("class_id").agg(F.sum("n").alias("others"))
    )
    roots = components(found.filter("kind = 1").select("a", "b").union(again.select("a", "b")))
    rooted = classes.select("class_id", "label", "embedding", "least", "n").join(
        roots.withColumnRenamed("node", "class_id"), "class_id", "left"
    ).withColumn("root", F.coalesce("root", "class_id")).join(counts, "class_id", "left")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select(
        "label", "embedding", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    linked = given.filter("whole").join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = given.filter("not whole").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
