"""Ranked lexical search: items against all documents, by products of blocks of sparse matrices in whole numbers.

Terms are runs of bytes other than 0x00-0x2F, 0x3A-0x40, 0x5B-0x60 and 0x7B-0x7F in UTF-8, with A-Z lower-cased. N documents have at least one
term and L terms in all; a term is in df of them and weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))). In a document of n terms
that has it tf times its impact is w * ((1000000000 tf) div (1000 tf + 8 m)) with m = 25 + (75 n N) div L. A document's score for an
item sums the impacts of the item's terms, repeats included.

Documents are read once, for the items' terms only: terms are found by 64-bit hashes of all words of a few megabytes at a time, and the bytes of
those that hit are compared. What is found is stored (per document its number of terms, and the items' terms in it with their occurrences),
and the counts N, L and df are sums over it. Then every task multiplies the items' matrix (items by terms, multiplicities) with
its documents' (terms by documents, impacts), a block of ``BLOCK`` documents at a time. Row by row, as Gustavson's method does: an item's
row is merged from its terms' rows of impacts in one dense accumulator, of which the k best are taken. The best of blocks are merged
in the task, the tasks' in Spark, in two steps, so that no task gets the rows of all.

Items are a stated set, read ``ITEM_BYTES`` of text at a time; each such group is one pass over the documents.

Edge cases: null and empty texts have no terms; a document with none is in no result; equal scores go by ascending doc_id, null ids last; repeated
documents count and rank each by itself, repeated items are ranked each by itself; items without terms have no rows; a very long text is hashed
whole by one task; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from .alignment import ranges
from .shared import stored

NEAREST = 10
BLOCK = 4096
#: Bytes of items' texts whose terms are looked for in one pass, and groups of tasks whose best are merged first.
ITEM_BYTES, GROUPS = 16 << 20, 64
#: Bytes of terms.
INSIDE = np.ones(256, bool)
INSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
INSIDE[[*range(0x41, 0x5B)]] = True  # read after lower-casing


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text in order."""
    data = at.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = at.runs(INSIDE[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class Terms:
    """The terms that are looked for, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        hashes = np.array([at.token_hash(t.decode()) for t in terms], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], order
        self.sizes = np.array([len(terms[k]) for k in order], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(terms[k] for k in order), np.uint8)
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # terms that share a hash: one, but for chance

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, and of those looked for: the text's row and the term's id)."""
        data, offsets = at.bytes_of(texts)
        data = at.LOWER[data]
        starts, ends, first = at.runs(INSIDE[data], offsets)
        if not len(starts) or not len(self.hashes):
            return np.diff(first), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = at.RollingHash(data).ranges(starts, ends)
        place = np.searchsorted(self.hashes, hashes)
        rows, ids = [], []
        for _ in range(self.alike):
            place_ = np.minimum(place, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[place_] == hashes) & (self.sizes[place_] == ends - starts) & (place < len(self.hashes)))
            known, size = place_[hit], self.sizes[place_[hit]]
            same = self.blob[ranges(self.begins[known], size)] == data[ranges(starts[hit], size)]
            wrong = np.zeros(len(hit), bool)
            wrong[np.repeat(np.arange(len(hit)), size)[~same]] = True
            rows.append(np.searchsorted(first, hit[~wrong], "right") - 1)
            ids.append(self.ids[known[~wrong]])
            place = place + 1
        return np.diff(first), np.concatenate(rows), np.concatenate(ids)


def frequencies(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the document), ids and counts: which of ``terms`` it holds, and how often; for documents with terms."""
    shipped = documents.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_for = Terms(shipped.value)
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                n, rows, ids = looked_for.find(texts)
                held, times = np.unique(rows * len(terms) + ids, return_counts=True)
                offsets = np.searchsorted(held, np.arange(len(texts) + 1) * len(terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (held % max(1, len(terms)), times)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["doc_id", "n", "ids", "counts"]).filter(pa.array(n > 0))

    return documents.select("doc_id", "text").mapInArrow(read, f"doc_id {dict(documents.dtypes)['doc_id']}, n long, ids array<int>, counts array<int>")


class Items:
    """The items' matrix by rows: of row i, terms and multiplicities at first[i] to first[i + 1]."""

    def __init__(self, items: list[list[int]]):
        rows = [np.unique(np.array(i, np.int64), return_counts=True) for i in items]
        self.first = np.cumsum([0, *(len(t) for t, _ in rows)])
        self.terms, self.times = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in (0, 1))

    def product(self, impacts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, documents, scores): the k best of ``n`` documents for each item, from the documents' matrix by rows of terms
        (first, documents, impacts); ids order equal scores."""
        first, documents, values = impacts
        sums = np.zeros(n, np.int64)
        for i in range(len(self.first) - 1):
            touched = []
            for term, times in zip(self.terms[self.first[i] : self.first[i + 1]].tolist(), self.times[self.first[i] : self.first[i + 1]].tolist(), strict=True):
                row = slice(first[term], first[term + 1])
                sums[documents[row]] += times * values[row]  # a term's row has a document once
                touched.append(documents[row])
            if not touched:
                continue
            if sum(map(len, touched)) > n:
                met = np.flatnonzero(sums)
            else:
                met = np.unique(np.concatenate(touched))
                met = met[sums[met] > 0]
            scores = sums[met]
            sums[met] = 0
            if len(met) > k:
                close = scores >= np.partition(scores, -k)[-k]
                met, scores = met[close], scores[close]
            order = np.lexsort((ids[met], -scores))[:k]
            yield i, met[order], scores[order]


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _ranked(spark: SparkSession, documents: DataFrame, items: list[tuple[int, str | None]], k: int) -> DataFrame:
    lists = [terms_of(t) for _, t in items]
    terms = sorted({t for ts in lists for t in ts})
    number = {t: j for j, t in enumerate(terms)}
    found = stored(frequencies(documents, terms))
    n, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in found.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():  # at most a row a term
        df[r["id"]] = r["count"]
    shipped = spark.sparkContext.broadcast((Items([[number[t] for t in ts] for ts in lists]), weights(n, df)))
    doc_type = dict(found.dtypes)["doc_id"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, w = shipped.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # item, score, id
        none = np.iinfo(np.int64).max
        for batch in batches:
            for k0 in range(0, batch.num_rows, BLOCK):
                block = batch.slice(k0, BLOCK)
                ids = block.column(0).cast(pa.int64()).fill_null(none).to_numpy()
                lengths, sizes = block.column(1).to_numpy(), np.diff(np.asarray(block.column(2).offsets))
                term, tf = (np.asarray(block.column(c).flatten()).astype(np.int64) for c in (2, 3))
                m = np.array([25 + (75 * x * n) // total for x in lengths.tolist()], np.int64)  # of any size, so in Python
                document = np.repeat(np.arange(len(ids)), sizes)
                impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[document]))
                order = np.argsort(term, kind="stable")
                first = np.searchsorted(term[order], np.arange(len(w) + 1))
                got = list(matrix.product((first, document[order], impact[order]), len(ids), k, ids))
                new = [np.concatenate(c) for c in zip(*((np.full(len(d), i), s, ids[d]) for i, d, s in got), strict=True)] if got else [best[0][:0]] * 3
                best = tuple(np.concatenate(c) for c in zip(best, new, strict=True))
                order = np.lexsort((best[2], -best[1], best[0]))
                rank = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
                best = tuple(c[order[rank < k]] for c in best)
        doc = pa.array(best[2], mask=best[2] == none).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), doc, pa.array(best[1])], ["item", "doc_id", "score"])

    rows = found.mapInArrow(multiply, "item long, doc_id long, score long").withColumn("group", F.spark_partition_id() % GROUPS)
    for keys in (["item", "group"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(items)], "item long, item_id long")
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc_id").cast(doc_type), "score")


def groups_of(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items, about ``limit`` bytes of text at a time."""
    group, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        group.append((r[0], r[1]))
        size += len(r[1] or "") + 64
        if size >= limit:
            yield group
            group, size = [], 0
    yield group


def search(documents: DataFrame, items: DataFrame, k: int = NEAREST) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    parts = [_ranked(documents.sparkSession, documents, group, k) for group in groups_of(items)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
