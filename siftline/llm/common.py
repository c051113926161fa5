"""What the corpus operators share: words, batches, what a worker keeps; tables, shared storage and pieces of batches are the library's."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.functions.batches import pieces_of  # noqa: F401
from siftline.sources.shared import stored  # noqa: F401  the operators import it from here
from siftline.sources.tables import table  # noqa: F401

#: The six characters that end a word: \x20 and \x09-\x0D. ``bytes.split()`` cuts at just these.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_owner: str | None = None
_dropped_by: list[Callable[[], object]] = []

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def dropped_by(drop: Callable[[], object]) -> None:
    """Have ``drop`` called when this process begins to work for another operator."""
    _dropped_by.append(drop)


def begin(owner: str) -> None:
    """Say at a task's start which operator this Python worker works for now.

    Spark lends a worker to task after task. What one operator keeps between its tasks (words' ids,
    tokenizers) would otherwise stay beside what the next ones need.
    """
    global _owner
    if owner != _owner:
        for drop in _dropped_by:
            drop()
        pa.default_memory_pool().release_unused()
        _owner = owner


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


TYPES = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def in_batches(
    df: DataFrame,
    rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
    schema: str | StructType,
    owner: str = "",
) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df``; nothing is kept from one batch to the next."""
    owner = owner or rows.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        for batch in batches:
            for part in pieces_of(batch):
                out = rows(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def per_text(
    docs: DataFrame,
    columns: list[tuple[str, str]],
    rows: Callable[[pa.Array], Iterable[tuple]],
    carry: Iterable[str] = ("doc_id",),
) -> DataFrame:
    """The ``carry`` columns of ``docs`` and, made by ``rows`` from the texts, those of ``columns``."""
    carry = list(carry)
    given = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    schema = StructType(given.schema.fields[:-1])
    for name, kind in columns:
        schema = schema.add(name, kind)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*rows(batch.column(len(carry))), strict=True)) or [[] for _ in columns]
        arrays = [pa.array(x, TYPES[kind]) for x, (_, kind) in zip(made, columns, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *arrays], names=schema.names)

    return in_batches(given, work, schema, rows.__module__)


def remainder(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
