"""Columns that are made of a frame's rows in Python, a slice of about a megabyte at a time.

A column function must give as many rows as Spark hands it, 64 MB of them, and holds all that it makes of them; here a slice's
results go out before the next slice is begun.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of the sliced column in a slice (more if a row alone has more).
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of whole rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = SLICE_BYTES + (int(ends[at - 1]) if at else 0)
        stop = max(at + 1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def mapped(df: DataFrame, column: str, kernel: Callable[[pa.RecordBatch], list[pa.Array]], more: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df without `drop`, and with the columns `more` (names and types) that `kernel` makes of slices by `column`."""
    keep = [c for c in df.columns if c not in drop]
    added = T.StructType.fromDDL(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *kernel(part)], [*keep, *added.names])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + added.fields))
