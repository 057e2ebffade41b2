"""Parts that the operators for training corpora share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.session import ship

#: Above this size (bytes, as rows x width) a side is shuffled instead of broadcast.
BROADCAST_BYTES = 64 << 20


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with this package on the executors; a worker gives back what memory a task leaves free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give free memory of this process back to the system, as far as that can be asked for. Workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of arrays or numpy columns in the order of schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def combined(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def small(df: DataFrame, width: int, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows, of width bytes each, are counted to fit in limit; else df as it is.

    df should be cheap to read (a checkpoint), for it is counted.
    """
    return F.broadcast(df) if df.count() * width <= (BROADCAST_BYTES if limit is None else limit) else df


def row_key(docs: DataFrame) -> Column:
    """64 bits of doc_id and text: what tells rows apart that share a doc_id. It is never used without doc_id, so a collision harms only rows of one doc_id."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, made from names, that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def segment_sum(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges ptr[i] .. ptr[i+1], 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]
