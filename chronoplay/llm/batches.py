"""Texts of an Arrow batch as one byte buffer, cut into bounded slices.

Python tasks get documents in Arrow batches. They look at the UTF-8 bytes of
many texts at once with numpy; a slice holds about ``SLICE`` bytes (or one
longer text), which bounds a task's memory whatever the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20


def row_slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, end row) of slices that hold about ``size`` bytes, or one longer text."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(texts):
        before = int(ends[row - 1]) if row else 0
        end = min(len(texts), max(row + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield row, end
        row = end


def byte_slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for slices of ``texts``; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for row, end in row_slices(texts, size):
        part = texts.slice(row, end - row).cast(pa.large_string()).fill_null("")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        yield row, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy(run):
    """``run`` for mapInArrow, giving memory back at the task's end: Spark keeps its Python workers, and they what they hold."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def spans_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The byte strings ``data[starts[i]:starts[i + 1]]`` (the last to the end), without a copy."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
