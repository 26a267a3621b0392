"""Arrays dealt to partitions as packed rows, so that a shuffle moves few dense rows instead of one for each entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def schema(*names: str) -> str:
    """Spark's schema of rows made by :func:`deal`."""
    return ", ".join(["part int", *(f"{n} binary" for n in names)])


def deal(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each partition number in ``part`` (0 or more), with the entries of each column packed in their order."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part = part[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rows = [pa.array(part[begin].astype(np.int32))]
    for values in columns.values():
        data = np.ascontiguousarray(values[order])
        off = (np.append(begin, len(data)) * (data.nbytes // max(1, len(data)))).astype(np.int32)
        rows.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(off), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(rows, ["part", *columns])


def entries(column: pa.Array, dtype) -> np.ndarray:
    """The entries packed in all rows of a binary column."""
    if not len(column):
        return np.zeros(0, dtype)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype) if data is not None else np.zeros(0, dtype)


def sizes(column: pa.Array, width: int) -> np.ndarray:
    """How many entries of ``width`` bytes each row of a binary column packs."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.diff(off).astype(np.int64) // width


def gather(batches: Iterator[pa.RecordBatch], **columns) -> list[np.ndarray]:
    """All entries of a partition's rows, column by column (name = dtype)."""
    got = [[entries(batch.column(n), t) for n, t in columns.items()] for batch in batches]
    return [np.concatenate([np.zeros(0, t), *(g[k] for g in got)]) for k, t in enumerate(columns.values())]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal neighbours begins, and its length."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` indices from ``begin``: which range each index is of, and the index."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]


def pieces(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` weight together, at least one entry each."""
    total = np.cumsum(weight)
    lo = 0
    while lo < len(weight):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right"))
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)
