"""NumPy views of Arrow text columns, shared by the operators that work on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: ASCII lower-casing and the white space bytes 0x09-0x0D and 0x20.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of ``column``, one row at least.

    Keeps the working memory of a task independent of how long the texts of a batch are.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts, ends = column_bytes(batch.column(column))
        total = np.cumsum(ends - starts)
        at = 0
        while at < batch.num_rows:
            used = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, used + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 buffer of a string column with each row's start and end; nulls are empty."""
    if pa.types.is_null(col.type) or not len(col):
        zero = np.zeros(len(col), dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), zero, zero
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(col) + 1, offset=col.offset * kind().itemsize).astype(np.int64)
    starts, ends = at[:-1], at[1:].copy()
    if col.null_count:
        gone = col.is_null().to_numpy(zero_copy_only=False)
        ends[gone] = starts[gone]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), starts, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (multiply and shift), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
