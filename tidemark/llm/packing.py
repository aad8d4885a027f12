"""Packing documents into sequences of at most ``LENGTH`` tokens, in order, by dynamic programming.

A task packs the documents of its input split in the order it reads them, some ``BLOCK`` tokens at a time, so nothing is
shuffled and memory is bounded. Cuts may fall at document ends (free), sentence ends (``SENTENCE``) or, in stretches without
either, inside a sentence (``HARD``). With f(p) the least cost of the tokens before cut p,
f(p) = penalty(p) + min over q >= p - LENGTH of f(q) + EACH + LENGTH - (p - q): padding is linear in p - q, so the best q is the
minimum of f(q) + q in a sliding window, which a monotone queue keeps. Windows of exactly 1024 or 2048 tokens need no padding.
What follows the last cut of a block is carried into the next one; at the end of the split the rest is split into powers of
two where that costs less than padding it.

Tokens: the tokenizers library's ids. White space separates tokens of this tokenizer and is dropped, so a text's ids are those of its
chunks between white space; each distinct chunk is encoded by the library once and kept in a table of bounded size. Arrow cuts a slice of texts
into chunks and finds the distinct ones; words of lower-case Latin letters are new to the library some at a time, in one text.

The tokenizer file is read by each worker from ``path``. Edge cases: a null or empty text is its end token alone; repeated rows
are packed each; a text longer than a sequence spans several; extra columns are ignored; an empty table gives no pieces. A
retried task reads the same split and gives the same sequences.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import arrowtext as at

LENGTH = 4096
BLOCK = 400_000
SENTENCE, HARD, EACH = 4, 96, 16
#: In a stretch of over GAP tokens without a sentence's end, hard cuts are allowed every GAP / 2 tokens.
GAP = 256
EXEMPT = (1024, 2048)
END = 2
#: Chunks kept per worker; 1.2 million take some 250 MB.
KEPT = 1_200_000
#: Words that are one unit to the tokenizer, whose last token ends with ``LAST``; and how many of them are encoded as one text.
PLAIN, LAST, TOGETHER = re.compile("[a-zß-öø-ÿ]+"), "</w>", 32
#: 1: lower-case letters and digits; 2: signs that are tokens of their own after these; an apostrophe may begin a token with what follows it.
KIND = np.zeros(256, np.uint8)
KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
KIND[list(b".,!?;:#$%&*|")] = 2


class Chunks:
    """Ids of texts by way of their chunks between white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(LAST)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 15, np.int64)
        self.ends = np.zeros(1 << 15, bool)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids back to back, their number by text)."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if PLAIN.fullmatch(c)]
        ids, _ = self._encoded([" ".join(plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(plain):  # else this vocabulary doesn't mark ends of words
            chunks = plain + [c for c in chunks if not PLAIN.fullmatch(c)]
            others, sizes = self._encoded(chunks[len(plain) :])
            ids, sizes = np.concatenate([ids, others]), np.concatenate([np.diff(ends, prepend=0), sizes])
        else:
            ids, sizes = self._encoded(chunks)
        k = len(self.known)
        while k + len(chunks) + 1 > len(self.begin):
            self.begin, self.ends = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.ends, 2 * len(self.ends))
        total = int(self.begin[k])
        while total + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[total : total + len(ids)] = ids
        self.begin[k + 1 : k + 1 + len(chunks)] = total + np.cumsum(sizes)
        self.ends[k : k + len(chunks)] = [c[-1:] in (".", "!", "?") for c in chunks]
        self.known.update(zip(chunks, range(k, k + len(chunks)), strict=True))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end token, places in them after which a sentence ends) of each text of a large_string array without nulls."""
        if len(self.known) > KEPT:
            self._forget()
        chunked = pc.ascii_split_whitespace(prepared(texts))
        # a text of white space alone has empty chunks, which have no ids
        distinct = chunked.flatten().dictionary_encode()
        chunks = distinct.dictionary.to_pylist()
        if unknown := [c for c in chunks if c not in self.known]:
            self._learn(unknown)
        places = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[distinct.indices.to_numpy()]
        first = self.begin[places]
        counts = self.begin[places + 1] - first
        after = np.concatenate([[0], np.cumsum(counts)])
        total = int(after[-1])
        flat = self.flat[np.repeat(first - after[:-1], counts) + np.arange(total)]
        stops = self.ends[places]
        rows = np.diff(chunked.offsets.to_numpy(), prepend=chunked.offsets[0].as_py())
        borders = np.cumsum(rows).tolist()
        for a, b in itertools.pairwise(borders):
            start = after[a]
            ids = np.empty(int(after[b] - start) + 1, np.uint32)
            ids[:-1] = flat[start : after[b]]
            ids[-1] = END
            yield ids, (after[a + 1 : b + 1] - start)[stops[a:b]]


def prepared(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a space between letters or digits and the signs after them: both are the tokenizer's own way,
    and done first they make fewer chunks. Texts that may hold special strings, which are matched before either, stay as they are."""
    data, offsets = at.bytes_of(texts)
    lowered = at.LOWER[data]
    kind = KIND[lowered]
    gaps = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    if len(special):
        for r in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
            lowered[offsets[r] : offsets[r + 1]] = data[offsets[r] : offsets[r + 1]]
            gaps = gaps[(gaps <= offsets[r]) | (gaps >= offsets[r + 1])]
    # a space between two texts, where the next begins with a sign, becomes the end of the first one
    moved = offsets + np.searchsorted(gaps, offsets, "right")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(np.insert(lowered, gaps, np.uint8(32))))


@cache
def chunk_encoder(path: str) -> Chunks:
    """One per worker and path."""
    return Chunks(path)


def cuts(total: int, documents: np.ndarray, sentences: np.ndarray, last: bool) -> list[int]:
    """Ends of the windows of tokens 0 to ``total``; documents and sentences: places where these end.

    Unless ``last``, the final window is left out: its tokens are to be packed with what follows."""
    soft = np.unique(np.concatenate([[0, total], documents, sentences]))
    wide = np.flatnonzero(np.diff(soft) > GAP)
    hard = [np.arange(soft[i] + GAP // 2, soft[i + 1], GAP // 2) for i in wide]
    at_places = np.unique(np.concatenate([soft, *hard]))
    fees = np.full(len(at_places), HARD)
    fees[np.searchsorted(at_places, sentences)] = SENTENCE
    fees[np.searchsorted(at_places, documents)] = 0
    exempt = []  # by size: the index of the place so far before each one, -1 if there is none
    for size in EXEMPT:
        i = np.searchsorted(at_places, at_places - size)
        exempt.append(np.where(at_places[i] == at_places - size, i, -1).tolist())
    least = np.searchsorted(at_places, at_places - LENGTH).tolist()
    places, fees = at_places.tolist(), (fees + EACH).tolist()
    cost, came = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int]] = deque()  # (f(q) + q, index of q), increasing in both
    for j, (p, fee, low, *whole) in enumerate(zip(places, fees, least, *exempt, strict=True)):
        if j == 0:
            continue
        g = cost[j - 1] + places[j - 1]
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j - 1))
        while queue[0][1] < low:
            queue.popleft()
        best, came[j] = queue[0]
        best += LENGTH - p
        for i in whole:
            if i >= 0 and cost[i] < best:
                best, came[j] = cost[i], i
        cost[j] = best + fee
    out, j = [], len(places) - 1
    while j:
        out.append(places[j])
        j = came[j]
    out.reverse()
    if not last:
        return out[:-1]
    rest = out[-1] - (out[-2] if len(out) > 1 else 0)
    powers = [1 << k for k in range(12, -1, -1) if rest >> k & 1]
    if LENGTH - rest > (len(powers) - 1) * (HARD + EACH):
        ends = (out[-1] - rest + np.cumsum(powers)).tolist()
        out[-1:] = ends
    return out


class Packer:
    """Takes documents in order and gives the pieces of finished sequences."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.waiting: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []  # doc_id, its tokens, start, ids, sentence ends
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray, sentences: np.ndarray) -> list[tuple]:
        self.waiting.append((doc_id, len(ids), 0, ids, sentences))
        self.tokens += len(ids)
        return self._pack(False) if self.tokens >= BLOCK else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.waiting else []

    def _pack(self, last: bool) -> list[tuple]:
        """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece."""
        ends = np.cumsum([len(w[3]) for w in self.waiting])
        begins = ends - [len(w[3]) for w in self.waiting]
        sentences = np.concatenate([w[4] + b for w, b in zip(self.waiting, begins.tolist(), strict=True)])
        windows = cuts(int(ends[-1]), ends, sentences, last)
        reach = windows[-1] if windows else 0
        edges = np.unique(np.concatenate([[0], windows, ends[ends < reach]])).tolist()
        window_at = np.searchsorted(windows, edges, "right")
        owner = np.searchsorted(ends, edges, "right")
        starts, out = [0, *windows], []
        for a, b, w, d in zip(edges, edges[1:], window_at.tolist(), owner.tolist(), strict=False):
            doc_id, tokens, base, ids, _ = self.waiting[d]
            k = a - int(begins[d])
            out.append((doc_id, base + k, b - a, zlib.crc32(ids[k : k + b - a].astype("<u4").tobytes()), tokens, self.sequence + w, a - starts[w]))
        self.sequence += len(windows)
        rest = []
        for (doc_id, tokens, base, ids, ends_in), begin in zip(self.waiting, begins.tolist(), strict=True):
            k = max(0, reach - begin)
            if k < len(ids):
                rest.append((doc_id, tokens, base + k, ids[k:], ends_in[ends_in > k] - k))
        self.waiting, self.tokens = rest, sum(len(r[3]) for r in rest)
        return out


def pack(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; sequence ids are unique, not consecutive."""
    kind = dict(documents.dtypes)["doc_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, schema = chunk_encoder(path), Packer(TaskContext.get().partitionId() << 36), None

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            schema = batch.schema.field(0).type
            for part, texts in at.slices(batch, "text"):
                pieces = []
                encoded = own.encode(texts)
                for doc_id, (ids, sentences) in zip(part.column(0).to_pylist(), encoded, strict=True):
                    pieces += packer.add(doc_id, ids, sentences)
                if pieces:
                    yield table(pieces)
        if pieces := packer.finish():
            yield table(pieces)

    return documents.select("doc_id", "text").mapInArrow(packed, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
