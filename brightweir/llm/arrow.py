"""Small helpers for functions given to mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def pieces(batch: pa.RecordBatch, text_col: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least; bounds what a step holds at once."""
    size = pc.fill_null(pc.binary_length(batch[text_col]), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])
