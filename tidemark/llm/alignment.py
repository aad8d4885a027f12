"""Cross-tokenizer alignment: where a byte-level tokenizer (A) and a sentence-piece model (B) cut texts alike.

A reads a space and the text, B the text (it adds the space itself); both without special tokens, whose strings are plain text. A token's bytes
are A's entry decoded byte by byte, or B's piece in UTF-8 with U+2581 read as a space and <0xHH> as that byte. An Arrow batch's tokens lie back
to back, texts at their byte offsets. The ends of A's and of B's tokens are counted per byte, once for each (``bincount``). Where both
occur, a group of tokens ends. Prefix sums of the counts say which tokens of A and B hold a byte, and their differences at the texts' borders
are the texts' own figures. Between two neighbouring ends of either kind lies one link: one token of A and one of B that overlap there, and no
two such cells have the same two tokens.

A pair of ids counts its links in the whole corpus. Every text's distinct pairs are stored with its figures, so that texts are read once, and
counted. Pairs with at least 1 / ``HEAVY`` of all links are at most ``HEAVY``, so they are given to
every task; they hold most links, and texts sum them where they are read. The other links meet their pair's count by a join, in which no pair
has more than 1 / ``HEAVY`` of all links.

Both tokenizers are asked for parts of texts that they read apart: the text is cut before spaces that follow a character that is not white space,
which is where A's pattern always cuts, and no piece of B may hold a space after another character (else, or with another pattern,
whole texts are asked for). Parts' ids are kept in a table, emptied when it has ``KEPT`` of them.

Edge cases: texts that are null or empty, or whose joined A or B bytes differ from the space and the text (those with U+2581, say), have no
tokens: zeros and an empty groups_sha256. Repeated rows count and are returned each by itself. Extra columns are ignored; an empty table gives
no rows. A very long text is held whole by the task that reads it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import cut, stored
from .tokencount import byte_characters

#: Pairs of at least one HEAVY-th of all links are broadcast; there are at most so many.
HEAVY = 1 << 18
#: Parts of texts whose ids a worker keeps, bytes of text aligned at a time, and rows of pairs summed at a time.
KEPT, SLICE, ROWS = 400_000, 1 << 20, 512
#: Fixed value: the space of sentence pieces.
SPACE_PIECE = "▁"
_WHITE = [chr(c) + " " for c in range(sys.maxunicode + 1) if chr(c).isspace()]
_CUT = re.compile(r"(?<=\S)(?= )")


class Vocabulary:
    """The bytes of every id and its decimal digits, as tables."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        width = len(str(len(entries)))
        self.digits = np.zeros((len(entries), width + 1), np.uint8)  # and a place for what follows the number
        self.lengths = np.array([len(str(i)) for i in range(len(entries))])
        for i in range(len(entries)):
            self.digits[i, : self.lengths[i]] = np.frombuffer(str(i).encode(), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids back to back."""
        return self.blob[ranges(self.begins[ids], self.sizes[ids])]


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... of sizes[0] numbers, then those of the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


class Pair:
    """Both tokenizers, and the ids of parts seen so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        of_byte = byte_characters()
        entries = sorted(self.a.get_vocab().items(), key=lambda e: e[1])
        self.a_words = Vocabulary([bytes(of_byte[c] for c in word) if all(c in of_byte for c in word) else word.encode() for word, _ in entries])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_words = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)])
        before = spec.get("pre_tokenizer") or {}
        self.by_parts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        self.space = [self.b.piece_to_id(SPACE_PIECE)]
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.stored = [_Lists(), _Lists()]

    def parts(self, text: str) -> list[str]:
        """The text's parts, each without the space before it."""
        if not self.by_parts:
            return [text]
        if not text.startswith(" ") and not any(map(text.__contains__, _WHITE)):
            return text.split(" ")
        return [part[1:] for part in _CUT.split(" " + text)]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, how many each text has, ids of B, how many)."""
        if len(self.known) > KEPT:
            self._empty()
        cut = [self.parts(t) for t in texts]
        of = list(itertools.chain.from_iterable(cut))
        new = list({p: None for p in of if p not in self.known})
        if new:
            self.known |= {p: k for k, p in enumerate(new, len(self.known))}
            self.stored[0].add([e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)])
            self.stored[1].add([i if p else self.space for p, i in zip(new, self.b.encode(new, num_threads=1), strict=True)])
        at_part = np.fromiter(map(self.known.__getitem__, of), np.int64, len(of))
        ends = np.cumsum([len(c) for c in cut])
        out = []
        for lists in self.stored:
            sizes = lists.sizes[at_part]
            total = np.concatenate([[0], np.cumsum(sizes)])[ends]
            out += [lists.flat[ranges(lists.begins[at_part], sizes)], np.diff(total, prepend=0)]
        return tuple(out)


class _Lists:
    """Lists of numbers in one array that grows."""

    def __init__(self):
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        more = int(sizes.sum())
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * more, np.int32)])
        self.flat[self.used : self.used + more] = np.fromiter(itertools.chain.from_iterable(lists), np.int32, more)
        self.begins = np.concatenate([self.begins, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += more


class Aligned:
    """The alignment of a run of texts.

    n_a, n_b, n_groups, n_links are figures of each text; a_ids and b_ids the tokens; link_a and link_b the ids of each link, and
    link_row its text."""

    def __init__(self, own: Pair, texts: pa.Array):
        data, offsets = at.bytes_of(texts)
        n = len(texts)
        self.own = own
        a_ids, a_per, b_ids, b_per = own.ids(texts.to_pylist())
        # a space before every text
        wanted = np.insert(data, offsets[:-1], 32)
        sizes = np.where(np.diff(offsets) > 0, np.diff(offsets) + 1, 0)
        keep = sizes > 0
        of_a, of_b = np.repeat(np.arange(n), a_per), np.repeat(np.arange(n), b_per)
        for words, ids, of in ((own.a_words, a_ids, of_a), (own.b_words, b_ids, of_b)):
            keep &= np.bincount(of, words.sizes[ids], n).astype(np.int64) == sizes
            keep &= np.bincount(of, words.sizes[ids] == 0, n) == 0
        first = offsets[:-1] + np.arange(n)
        for words, ids, of in ((own.a_words, a_ids, of_a), (own.b_words, b_ids, of_b)):
            rows = np.flatnonzero(keep)
            differ = words.joined(ids[keep[of]]) != wanted[ranges(first[rows], sizes[rows])]
            if differ.any():
                keep[np.repeat(rows, sizes[rows])[differ]] = False
        self.a_ids, of_a, self.b_ids, of_b = a_ids[keep[of_a]], of_a[keep[of_a]], b_ids[keep[of_b]], of_b[keep[of_b]]
        sizes = np.where(keep, sizes, 0)
        border = np.concatenate([[0], np.cumsum(sizes)])  # byte offsets of the texts, and of the end
        a_end, b_end = np.cumsum(own.a_words.sizes[self.a_ids]), np.cumsum(own.b_words.sizes[self.b_ids])
        ends_a, ends_b = np.bincount(a_end, minlength=border[-1] + 1), np.bincount(b_end, minlength=border[-1] + 1)
        self.cuts = np.flatnonzero(ends_a & ends_b)
        cells = np.flatnonzero(ends_a | ends_b)
        a_sum, b_sum = np.cumsum(ends_a), np.cumsum(ends_b)
        self.n_a, self.n_b = np.diff(a_sum[border]), np.diff(b_sum[border])
        self.n_groups = np.diff(np.cumsum(ends_a & ends_b)[border])
        self.n_links = np.diff(np.cumsum(ends_a | ends_b)[border])
        self.link_a, self.link_b = self.a_ids[a_sum[cells - 1]], self.b_ids[b_sum[cells - 1]]
        self.link_row = np.repeat(np.arange(n), self.n_links)
        # each token's group: the cuts before its end
        self.a_group, self.b_group = np.searchsorted(self.cuts, a_end), np.searchsorted(self.cuts, b_end)

    def pairs(self) -> np.ndarray:
        """A's id * 2^32 + B's id of every link."""
        return self.link_a.astype(np.int64) << 32 | self.link_b

    def hashes(self) -> list[str]:
        """Of each text the SHA-256 of its groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        a_before = np.searchsorted(self.b_group, self.a_group)  # tokens of B in earlier groups
        b_before = np.searchsorted(self.a_group, self.b_group, "right")  # tokens of A in earlier groups and its own
        na, nb = len(self.a_ids), len(self.b_ids)
        width = max(self.own.a_words.digits.shape[1], self.own.b_words.digits.shape[1])
        digits, lengths = np.zeros((na + nb, width), np.uint8), np.zeros(na + nb, np.int64)
        for words, ids, group, before, mark in ((self.own.a_words, self.a_ids, self.a_group, a_before, b"|"), (self.own.b_words, self.b_ids, self.b_group, b_before, b";")):
            place, size = np.arange(len(ids)) + before, words.lengths[ids]
            rows = np.zeros((len(ids), width), np.uint8)
            rows[:, : words.digits.shape[1]] = words.digits[ids]
            last = np.append(group[1:] != group[:-1], True)[: len(ids)]
            rows[np.arange(len(ids)), size] = np.where(last, mark[0], ord(","))
            digits[place], lengths[place] = rows, size + 1
        flat = digits[digits > 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends, strict=False)]


@cache
def pair(a_path: str, b_path: str) -> Pair:
    """One per worker and paths."""
    return Pair(a_path, b_path)


_FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def distinct_links(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, links, offsets): the distinct pairs of each text, how many of its links hold them, and where each text's begin and end."""
    known, place = np.unique(found.pairs(), return_inverse=True)
    held, links = np.unique(found.link_row * max(1, len(known)) + place, return_counts=True)
    return known[held % max(1, len(known))], links, np.searchsorted(held, np.arange(len(found.n_links) + 1) * max(1, len(known)))


def linked(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the row's distinct pairs (A's id * 2^32 + B's id) with their links."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        for batch in batches:
            for part, texts in at.slices(batch, "text", SLICE):
                found = Aligned(own, texts)
                pairs, links, offsets = distinct_links(found)
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in (pairs, links.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), *map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(found.hashes(), pa.string()), *lists], names)

    names = ["row", "doc_id", *(f.split()[0] for f in _FIGURES.split(", ")), "pairs", "links"]
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(read, f"row long, doc_id {dict(documents.dtypes)['doc_id']}, {_FIGURES}, pairs array<long>, links array<int>")


def align(documents: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    table = stored(linked(documents, a_path, b_path))
    each = table.select(F.explode(F.arrays_zip("pairs", "links")).alias("l"))
    counts = cut(each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.links").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))  # an id of B a row
    marked = cut(counts.withColumn("b", b_id).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))
    least = (marked.agg(F.sum("count")).first()[0] or 0) / heavy
    common = marked.where(F.col("count") >= least).orderBy("pair").toPandas()  # at most ``heavy`` rows
    shipped = documents.sparkSession.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["count"].to_numpy(np.int64), common["best"].to_numpy(bool)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums a text, with a pair of its own that nothing meets, and a row for each of its pairs that isn't common."""
        pairs, totals, best = shipped.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                row, n = part.column(0).to_numpy(), part.num_rows
                codes, links = (np.asarray(part.column(c).flatten()).astype(np.int64) for c in (1, 2))
                of = np.repeat(np.arange(n), np.diff(np.asarray(part.column(1).offsets)))
                place = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
                hit = pairs[place] == codes if len(pairs) else np.zeros(len(codes), bool)
                ends = np.searchsorted(of[hit], np.arange(n), "right")
                # prefix sums of whole numbers: bincount's weights are doubles
                sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends], prepend=0) for v in (links[hit] * best[place[hit]], links[hit] * totals[place[hit]])]
                rest = ~hit
                columns = [np.concatenate([x, y]) for x, y in ((row, row[of[rest]]), (-1 - row, codes[rest]), (np.zeros(n, np.int64), links[rest]), *((v, np.zeros(rest.sum(), np.int64)) for v in sums))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "pair", "links", "n_best", "count_sum"])

    sums = table.select("row", "pairs", "links").mapInArrow(summed, "row long, pair long, links long, n_best long, count_sum long")
    met = sums.join(marked.where(F.col("count") < least), "pair", "left")
    added = {"n_best": F.when(F.col("best"), F.col("links")).otherwise(0), "count_sum": F.col("links") * F.coalesce("count", F.lit(0))}
    whole = met.groupBy("row").agg(*(F.sum(F.col(c) + v).alias(c) for c, v in added.items()))
    return table.drop("pairs", "links").join(whole, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
