"""Shared folder, size-checked joins and Arrow plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.checkpoints import cut, store, table_path

__all__ = ["buffers", "cut", "fresh", "hint_small", "table_path", "text_views", "trimmed", "write_table"]

#: A side with at most so many rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 1 << 18


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    return store(df, name)


def hint_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``most`` rows (counted unless given), else leave it to a shuffle join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_q_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_views(col: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of a string array of about SLICE_BYTES bytes, with their first row. Nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null("")
    lens = np.asarray(pa.compute.binary_length(col), dtype=np.int64)
    part = np.cumsum(lens) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(col)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield a, col.slice(a, b - a)


def _trim() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over the batches of a task, or over the table of a group, that gives freed memory back at its end. A worker is used again, for other operators too, and would keep the most that any task took."""

    @functools.wraps(run)
    def batches_trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    @functools.wraps(run)
    def table_trimmed(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            _trim()

    return batches_trimmed if inspect.isgeneratorfunction(run) else table_trimmed


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string or binary array."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]
