"""Per-document list columns in Arrow batches, read without making a Python object of each element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], *columns: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into rows that hold about ``most`` bytes in their (string or binary) ``columns``, one row at least.

    What is made of a row is many times its text, so a batch of thousands of rows must not be in memory at once.
    """
    most = SLICE_BYTES if most is None else most
    for b in batches:
        sizes = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, stop - at)
            at = stop


class Parts:
    """The byte strings of a list column (of binary or strings), row by row: their joined bytes and their bounds from 0."""

    def __init__(self, column: pa.ListArray):
        values = column.values
        wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
        self.rows = column.offsets.to_numpy()
        if len(values):
            self.at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
            self.data = memoryview(values.buffers()[2] or b"").cast("B")
        else:
            self.at, self.data = np.zeros(1, np.int64), memoryview(b"")

    def row(self, i: int) -> tuple[memoryview, np.ndarray]:
        at = self.at[self.rows[i] : self.rows[i + 1] + 1].astype(np.int64)
        return (self.data[at[0] : at[-1]], at - at[0]) if len(at) else (self.data[:0], np.zeros(1, np.int64))


class Numbers:
    """The numbers of a list column, row by row."""

    def __init__(self, column: pa.ListArray):
        self.rows = column.offsets.to_numpy()
        self.values = column.values.to_numpy(zero_copy_only=False)

    def row(self, i: int) -> np.ndarray:
        return self.values[self.rows[i] : self.rows[i + 1]]

    def bounds(self, i: int) -> np.ndarray:
        """Running sums from 0 of a row of lengths."""
        return np.concatenate([[0], np.cumsum(self.row(i), dtype=np.int64)])
