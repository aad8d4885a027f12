"""Reading text columns of Arrow batches as flat byte arrays, a few megabytes at a time.

Tasks stay small whatever the batch size: ``slices`` cuts a batch into runs of rows of about
``SLICE_BYTES`` of text. A single longer text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20


def text_array(column: pa.Array) -> pa.Array:
    """The column as large_string with nulls read as empty texts."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a large_string array within its data buffer."""
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets): the UTF-8 bytes of all rows back to back, and each row's start, n + 1 values from 0."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = offsets_of(column)
    buffer = column.buffers()[2]
    if buffer is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(buffer, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with about ``limit`` bytes of text each, with the text column as large_string."""
    texts = text_array(batch.column(batch.schema.get_field_index(text)))
    off = offsets_of(texts)
    start, n = 0, len(texts)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        stop = min(stop, n)
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: Bytes 0x20 and 0x09-0x0D separate words; bytes of longer UTF-8 sequences never do.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row starts): maximal runs of true bytes, cut at row borders; run k of row r has
    row_starts[r] <= k < row_starts[r + 1]."""
    n = len(inside)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class RollingHash:
    """64-bit polynomial hashes of many byte ranges at once: prefix sums of byte * P^i, times P^-start."""

    P = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.n = n
        powers = np.full(n + 1, self.P, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.prefix[1:])
        powers[1:] = self.INVERSE
        np.multiply.accumulate(powers, out=powers)
        self.inverse = powers

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def token_hash(word: str) -> int:
    """The hash RollingHash gives the UTF-8 bytes of one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(RollingHash(data).ranges(np.zeros(1, np.int64), np.array([len(data)]))[0])
