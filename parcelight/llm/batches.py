"""Arrow batches of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; a longer text is a slice of its own.
TEXT_BYTES = 4 << 20


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500, text: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Spark's batches in slices of a bounded number of rows and bytes of text, so that few texts at a time exist as Python
    objects and arrays of their letters."""
    for batch in batches:
        total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + most, side="right")) - 1
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
