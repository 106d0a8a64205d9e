"""Arrow batches cut so that a worker holds a bounded number of bytes of text at once, and names that clash with no column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column starts with it, in either case of letters."""
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: int, rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``size`` bytes in the text column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, upto - at)
        at = upto
