"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator


def slices(batches: Iterator, column: str, limit: int = 4_000_000, rows: int = 1024) -> Iterator:
    """Arrow batches cut into slices of at most `limit` bytes in a string or list column and at most `rows` rows, one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
        at = total = 0
        for i, n in enumerate(sizes.to_pylist()):
            if i > at and (total + (n or 0) > limit or i - at == rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n or 0
        if batch.num_rows > at:
            yield batch.slice(at)
