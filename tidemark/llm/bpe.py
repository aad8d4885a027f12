"""Byte-level BPE encoding and decoding.

``pretokens`` cuts the texts by scans over code-point classes; each distinct piece is merged once (lowest rank
first, leftmost of equals) and kept in a table of bounded size; a batch's ids are then gathered from the table.
The byte offsets of the tokens are kept, and decoding lays each id's bytes at its offset.

The rank file (tiktoken's format) is read by each worker from ``path``, which must exist on every machine.
Edge cases: a null text counts as empty; an empty text has no ids; long texts are encoded in pieces that end
where a token ends; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at
from . import pretokens

#: Pieces kept per worker; at 600 000 of about 10 bytes the table takes some 120 MB.
KEPT = 600_000
#: Longer pieces are merged with a heap.
LONG = 48


def merge_long(symbols: list, rank: Callable, joined: Callable) -> list:
    """Byte-pair merging with a heap of ranked pairs over a doubly linked list: n log n for any length.

    rank(a, b) is None for a pair that doesn't merge; joined(a, b) is what it merges into."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has merged since
        symbols[i] = joined(a, b)
        symbols[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank(symbols[i], symbols[k])) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := rank(symbols[h], symbols[i])) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return [s for s in symbols if s is not None]


class Encoder:
    """Ids of texts by a table of ranks, and the bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, i in self.ranks.items():
            tokens[i] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat: list[int] = []
        self.begin: list[int] = [0]

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > LONG:
            parts = merge_long(parts, lambda a, b: ranks.get(a + b), lambda a, b: a + b)
            return [ranks[p] for p in parts]
        never = len(ranks) + 1
        pairs = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) != never:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        return [ranks[p] for p in parts]

    def _gathered(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        if len(self.known) > KEPT:
            self._forget()
        known, get = self.known, self.known.get
        places = np.array([get(p, -1) for p in pieces], np.int64)
        for i in np.flatnonzero(places < 0).tolist():
            piece = pieces[i]
            place = get(piece)
            if place is None:
                place = known[piece] = len(self.begin) - 1
                self.flat.extend(self.merged(piece))
                self.begin.append(len(self.flat))
                self._arrays = None
            places[i] = place
        if self._arrays is None:
            self._arrays = np.array(self.flat, np.uint32), np.array(self.begin, np.int64)
        flat, begin = self._arrays
        counts = begin[places + 1] - begin[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(begin[places] - (ends - counts), counts) + np.arange(total)], counts

    _arrays: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, ids, byte offsets of the tokens within their part, id offsets of the rows); parts of one long text follow each other."""
        for first, local, raw, starts, row in pretokens.pieces_of(texts):
            bounds = [*starts.tolist(), len(raw)]
            ids, counts = self._gathered([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
            sizes = self.token_length[ids]
            rows = len(local) - 1
            of_rows = np.concatenate([[0], np.cumsum(np.bincount(row, counts, rows).astype(np.int64))])
            yield first, ids, np.cumsum(sizes) - sizes, of_rows

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ids; offsets (where each token begins) are computed where not given."""
        sizes = self.token_length[ids]
        offsets = np.cumsum(sizes) - sizes if offsets is None else offsets
        total = int(sizes.sum())
        return self.token_bytes[np.repeat(self.token_start[ids] - offsets, sizes) + np.arange(total)].tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One per worker and path."""
    return Encoder(path)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 for every row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                n = len(texts)
                tokens, hashes = np.zeros(n, np.int64), [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
                for first, ids, offsets, of_rows in own.encode(texts):
                    raw = own.decode(ids, offsets)
                    ends = np.append(offsets, len(raw))
                    for r, (a, b) in enumerate(zip(of_rows[:-1].tolist(), of_rows[1:].tolist(), strict=True), first):
                        if b > a:
                            tokens[r] += b - a
                            hashes[r][0].update(ids[a:b].astype("<u4").tobytes())
                            hashes[r][1].update(raw[ends[a] : ends[b]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array([h.hexdigest() for h, _ in hashes]), pa.array([h.hexdigest() for _, h in hashes])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(encoded, f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
