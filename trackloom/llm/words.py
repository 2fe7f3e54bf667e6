"""Words of UTF-8 text as spans of an Arrow buffer: bytes are classified by a look-up table, ends found by differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .blocks import text_bytes

#: Bytes of text that are worked on together, so that the arrays of a batch stay small; one longer text is taken alone.
SLICE_BYTES = 4_000_000


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(is a byte one of a word, its lower case): digits, letters, and all bytes of characters beyond ASCII."""
    byte = np.arange(256, dtype=np.uint8)
    lower = byte.copy()
    lower[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
    digit, letter = (byte >= ord("0")) & (byte <= ord("9")), (lower >= ord("a")) & (lower <= ord("z"))
    return digit | letter | (byte >= 0x80), lower


IN_WORD, LOWER = _classes()


def slices(batch: pa.RecordBatch, column: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows of a batch in runs of about ``slice_bytes`` of text, one row at least."""
    table = pa.Table.from_batches([batch])
    _, ends = text_bytes(table, column)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + slice_bytes, "right")) - 1)
        yield table.slice(start, stop - start)
        start = stop


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, rows) of the words of texts that lie end to end, ``ends`` being their offsets."""
    inside = IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True  # no word runs over the end of a text
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts, np.searchsorted(ends, starts, "right") - 1
