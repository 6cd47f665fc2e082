"""Arrow batches cut to a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Workers live long and share an executor's memory: batches that are done go back to the system.
pa.set_memory_pool(pa.system_memory_pool())

#: Text bytes a task works on at once; one longer text makes a piece by itself.
CHUNK_BYTES = 1 << 20


def text_pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of the batches with at most ``limit`` bytes of ``column``, or one row.

    Gives the slice and its texts, a null text as the empty one.
    """
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def raw_text(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (one more at the end)."""
    wide = texts.type == pa.large_string()
    _, where, data = texts.buffers()
    n = len(texts)
    if where is None or data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
