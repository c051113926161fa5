"""Arrow batches, cut to sizes that Python can bear."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa


def pieces_of(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most_bytes``, so that long texts don't pile up in Python."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def in_pieces(batches: Iterable[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """All of these batches, piece by piece; small ones, for what is made of a page is larger than it."""
    return chain.from_iterable(pieces_of(batch, most_bytes) for batch in batches)
