"""Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once.
BATCH_BYTES = 4 << 20


def short_batches(batches: Iterator[pa.RecordBatch], texts: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where the texts of column number ``texts`` pass ``most`` bytes, at one row at least.

    Spark bounds batches by rows; what is worked out of a batch's letters takes many times their size.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def short_lists(texts: Sequence[str | None], most: int = BATCH_BYTES) -> Iterator[Sequence[str | None]]:
    """The texts cut where their letters pass ``most``, at one text at least."""
    at, letters = 0, 0
    for i, t in enumerate(texts):
        letters += len(t or "")
        if letters > most and i > at:
            yield texts[at:i]
            at, letters = i, len(t or "")
    if at < len(texts):
        yield texts[at:]
