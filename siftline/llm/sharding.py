"""Operator 11, shards in the order of a Hilbert curve through the metadata.

Several columns are quantised to ``BITS`` bits each, so that cells of a column hold about equally many rows; a row's
cells are a point of a grid, and the point's place on the Hilbert curve through the grid is its curve index.
Rows are sorted by it and cut into runs, one a shard. Near points of the curve are near in every column, so
a shard holds a short range of each, and a filter on any of them leaves most shards out by their least and greatest values.

All of it is DataFrame operations. Cells come from counts over all rows: a number's leading bits, counted
from the column's least value, have at most a few thousand values; texts are counted whole. Only the cuts, 2 ** BITS - 1
a column at most, come to the driver. Rows are placed by ranges (``placed``): no task holds all rows, nor
all of a cell, a source or a group of copies, since ties on the curve go on by the texts' checksums and the ids.

Laws: ``rows`` makes the counts of shards differ by one at most; ``bytes`` cuts where a shard's share of all
bytes is reached, so that a shard is at most half a row at each end away from it.

Defined results: a null or empty text has the size 16 and the checksum 0. Nulls are below every value of a column, and are
a cell of their own. Repeated rows stand side by side, in any order, which no column shows. An empty table
has no rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import stored

SHARDS = 40
BITS = 4
#: The columns of the grid. Queries filter by them.
DIMENSIONS = ["source", "lang", "n_chars", "doc_id"]
#: What a row takes besides its text, in bytes.
OVERHEAD = 16
LAWS = ("rows", "bytes")


def placed(df: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """``__before_`` each weight: its sum over all rows that come before in an order of all rows; nulls come first.

    Rows are sorted by ranges and written; a row's sum is that within its range, after those of the ranges before,
    of which there is one row each.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranges").withColumn("__part", F.shiftright("__id", 33))
    sums = ranged.groupBy("__part").agg(*(F.sum(w).alias(f"__{w}") for w in weights))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__part", *(F.coalesce(F.sum(f"__{w}").over(earlier), F.lit(0)).alias(f"__{w}") for w in weights))
    within = W.partitionBy("__part").orderBy("__id").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    inside = {w: place if w == "__one" else F.coalesce(F.sum(w).over(within), F.lit(0)) for w in weights}
    joined = ranged.join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, *((F.col(f"__{w}") + inside[w]).alias(f"__before_{w.strip('_')}") for w in weights))


def steps_of(value: Column) -> Column:
    """A number of 0 or more by its leading bits: 32 steps to each doubling, in the numbers' order."""
    grown = value + 1
    power = F.floor(F.log2(grown))
    return (power * 32 + F.floor(grown / F.pow(F.lit(2.0), power) * 32) - 32).cast("long")


def cuts(keys: DataFrame, name: str) -> list:
    """The least key of each of 2 ** BITS cells at most, that hold about equally many rows; the least of all is left out."""
    counted = keys.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("rows"))
    ordered = stored(placed(counted, [name], ["rows"]), "quantiles")
    total = F.broadcast(ordered.agg(F.sum("rows").alias("total")))
    cell = F.expr(f"(__before_rows * {1 << BITS}L) div total")
    least = ordered.crossJoin(total).groupBy(cell.alias("__cell")).agg(F.min(name).alias("least"))
    return sorted(r["least"] for r in least.collect())[1:]


def cell_of(key: Column, found: list) -> Column:
    """0 for null, else one more than the number of cuts that the key reaches."""
    reached = F.size(F.filter(F.array(*map(F.lit, found)), lambda cut: cut <= key)) if found else F.lit(0)
    return F.when(key.isNull(), 0).otherwise(F.least(reached + 1, F.lit((1 << BITS) - 1))).cast("int")


def cells(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """``docs`` with ``__cells``, an array of a number below 2 ** BITS for each dimension."""
    numbers = [d for d in dimensions if isinstance(docs.schema[d].dataType, NumericType)]
    least = docs.agg(*(F.min(F.col(d).cast("double")).alias(d) for d in numbers)).first() if numbers else {}
    keys = {d: steps_of(F.col(d).cast("double") - F.lit(least[d] or 0.0)) if d in numbers else F.col(d).cast("string") for d in dimensions}
    keyed = docs.select("*", *(k.alias(f"__{d}") for d, k in keys.items()))
    found = {d: cuts(keyed.select(f"__{d}"), f"__{d}") for d in dimensions}
    made = keyed.withColumn("__cells", F.array(*(cell_of(F.col(f"__{d}"), found[d]) for d in dimensions)))
    return made.drop(*(f"__{d}" for d in dimensions))


def hilbert_index(point: str, n: int, bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a point, an array of ``n`` whole numbers of ``bits`` bits.

    After J. Skilling, Programming the Hilbert curve (2004): the axes are turned into the transposed index a bit and axis at a
    time, from the highest; then they are Gray-encoded, and their bits interleaved.
    """
    masks = [1 << k for k in range(bits - 1, 0, -1)]
    turns = ", ".join(f"struct({q} AS q, {i} AS i)" for q in masks for i in range(n)) or "struct(0 AS q, 0 AS i)"
    turned = f"""aggregate(array({turns}), {point}, (x, s) -> if(x[s.i] & s.q <> 0,
        transform(x, (v, k) -> if(k = 0, v ^ (s.q - 1), v)),
        transform(x, (v, k) -> if(s.i <> 0 and (k = 0 or k = s.i), v ^ ((x[0] ^ x[s.i]) & (s.q - 1)), v))))"""
    gray = "transform(x, (v, k) -> aggregate(slice(x, 1, k + 1), 0, (a, b) -> a ^ b))"
    flip = f"aggregate(array({', '.join(map(str, masks)) or 0}), 0, (a, q) -> if(g[{n - 1}] & q <> 0, a ^ (q - 1), a))"
    places = ", ".join(f"struct({k} AS k, {i} AS i)" for k in range(bits - 1, -1, -1) for i in range(n))
    index = f"aggregate(array({places}), 0L, (a, p) -> a * 2 + (shiftright(y[p.i], p.k) & 1))"
    # transform() over an array of one names a value that is used again
    flipped = f"transform(array({flip}), f -> transform(g, v -> v ^ f))[0]"
    return F.expr(f"transform(transform(transform(array({turned}), x -> {gray}), g -> {flipped}), y -> {index})[0]")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, law: str = "rows", dimensions: list[str] = DIMENSIONS, with_text: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot (the row's place in its shard), grown_shard (null), curve."""
    if law not in LAWS:
        raise ValueError(f"no such law: {law}")
    text = F.col("text").cast("string")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]
    keep = [c for c in docs.columns if c not in made]
    sized = docs.select(
        *(c for c in keep if with_text or c != "text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    narrow = sized if with_text else stored(sized, "metadata")  # read again for each dimension
    pointed = cells(narrow, dimensions).withColumn("curve", hilbert_index("__cells", len(dimensions))).drop("__cells")
    order = ["curve", "text_crc32", *(c for c in ("doc_id", "source", "lang") if c in docs.columns)]
    weight = "__one" if law == "rows" else "size"
    weighted = pointed.withColumn("__one", F.lit(1).cast("long"))
    ordered = placed(weighted, order, ["__one"] if law == "rows" else ["__one", "size"])
    total = ordered.agg(F.sum(weight).alias("__total"))
    if law == "rows":
        cut = ordered.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"(__before_one * {shards}L) div __total").cast("int"))
        # a shard's first row is the least that the division gives to it
        slot = F.col("__before_one") - F.expr(f"(shard * __total + {shards - 1}L) div {shards}L")
        cut = cut.withColumn("slot", slot)
    else:
        middle = f"(cast(__before_size as decimal(38,0)) * 2 + size) * {shards} div (cast(__total as decimal(38,0)) * 2)"
        cut = stored(ordered.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(middle).cast("int")), "cut")
        first = cut.groupBy("shard").agg(F.min("__before_one").alias("__first"))
        cut = cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("__before_one") - F.col("__first"))
    named = cut.withColumn("law", F.lit(law)).withColumn("grown_shard", F.lit(None).cast("int"))
    return named.select(*(c for c in keep if with_text or c != "text"), *made)


def written(sharded: DataFrame, path: str, files: int) -> None:
    """Write shards as folders of Parquet files, sorted; a shard of many rows is many files, each a run of slots."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(sharded: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """A row per shard: rows, bytes, and the least and greatest value and the nulls of each dimension."""
    found = [f(d).alias(f"{p}_{d}") for d in dimensions for p, f in (("least", F.min), ("greatest", F.max))]
    nulls = [F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in dimensions]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *found, *nulls)


def shards_with(ranges: DataFrame, dimension: str, low: object, high: object) -> DataFrame:
    """The shards that may hold rows whose dimension is from ``low`` to ``high``."""
    return ranges.filter((F.col(f"greatest_{dimension}") >= F.lit(low)) & (F.col(f"least_{dimension}") <= F.lit(high))).select("shard")


def shard_map(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every document."""
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return hilbert_shards(narrow, with_text=False).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")
