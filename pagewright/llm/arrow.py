"""Arrow helpers for functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts hold about ``most_bytes`` at most, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
