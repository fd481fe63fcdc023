"""Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of texts that are turned into Python objects at once, whatever the size of a batch.
ROWS = 128


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that what a worker makes of a part doesn't grow with the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
