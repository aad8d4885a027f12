"""Token counts: byte-pair merging with a heap and a linked list, no ids made.

Each piece (see ``pretokens``) starts as its bytes; the adjacent pair of lowest rank is popped and merged until none
is left; the piece's count is its initial symbols minus the merges. Counts of pieces are kept in a table of bounded size.
The tokenizer's special strings count one token each where they stand in a text, and cut it.

The tokenizer file (the tokenizers library's JSON, byte-level BPE) is read by each worker from ``path``.
Edge cases: a null text counts as empty; an empty text has no tokens; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import pretokens

KEPT = 800_000
LIMIT = 512


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the rest
    follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        of_byte = byte_characters()
        number = {c: b for c, b in of_byte.items()}  # symbols 0-255 are the bytes
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            new = number.setdefault(a + b, len(number))
            self.pairs.setdefault(number[a] << 20 | number[b], (rank, new))
        self.known: dict[bytes, int] = {}

    def count(self, piece: bytes) -> int:
        """Symbols left of one piece when no ranked pair remains."""
        symbols, pairs = list(piece), self.pairs
        n = len(symbols)
        heap = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get(symbols[i] << 20 | symbols[i + 1]))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            merges += 1
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get(new << 20 | symbols[k]):
                    heapq.heappush(heap, (p[0], i, new, symbols[k], p[1]))
            h = before[i]
            if h >= 0 and (p := pairs.get(symbols[h] << 20 | new)):
                heapq.heappush(heap, (p[0], h, symbols[h], new, p[1]))
        return n - merges

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray | None, np.ndarray]:
        """(texts without special strings, the row of each or None if they are the rows, special strings per row)."""
        extra = np.zeros(len(texts), np.int64)
        data, _ = at.bytes_of(texts)
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return texts, None, extra
        parts, rows = [], []
        for r, text in enumerate(t.as_py().encode() for t in texts):
            cut = [text]
            for s in self.special:
                cut = [x for c in cut for x in c.split(s)]
            extra[r] = sum(text.count(s) for s in self.special)
            parts += cut
            rows += [r] * len(cut)
        return pa.array([p.decode() for p in parts], pa.large_string()), np.array(rows), extra

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        parts, rows, total = self._parts(texts)
        if len(self.known) > KEPT:
            self.known = {}
        known = self.known
        for first, local, raw, starts, row in pretokens.pieces_of(parts):
            bounds = [*starts.tolist(), len(raw)]
            pieces = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] if len(starts) else []
            got = [known.get(p, 0) for p in pieces]
            if 0 in got:
                for i, n in enumerate(got):
                    if not n:
                        piece = pieces[i]
                        n = known.get(piece)
                        if n is None:
                            n = known[piece] = self.count(piece)
                        got[i] = n
            at_row = row + first
            total += np.bincount(at_row if rows is None else rows[at_row], got, len(texts)).astype(np.int64) if pieces else 0
        return total


@cache
def counter(path: str) -> Counter:
    """One per worker and path."""
    return Counter(path)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                sizes = np.diff(at.offsets_of(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(own.counts(texts))], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select("doc_id", "text").mapInArrow(counted, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
