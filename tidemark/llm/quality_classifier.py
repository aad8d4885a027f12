"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A text is cut into words (letters), numbers and punctuation runs; single tokens, pairs of neighbours, and
two markers (a token that repeats its predecessor; a run of three tokens seen before in the text) are hashed
into ``DIM`` buckets. A bucket's value is log(1 + count), and a text's values are scaled to a common length. The
score is the sigmoid of the sparse dot product with the weights.

Training takes at most ``train_rows`` labelled rows, those with the smallest hashes of their ids, so it costs
the same at any corpus size. They are dealt to ``SHARDS`` groups; in each epoch every group runs FTRL-proximal
updates from the common state, and one task averages the states (``SHARDS`` x 2 MB), of which the driver gets the mean.

Edge cases: a null text scores as the empty text; an empty text has no features, so its score is the sigmoid
of the bias; rows with a null id or label don't train; of rows that share an id one trains; repeated rows get the same score each; with no label
rows, or one class only, every score follows from the bias alone; extra columns are ignored. A text of over
4 MB is read in pieces that end at white space, with the last two tokens and the triples seen so far carried from piece to piece, so
its vector is that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import cut

DIM = 1 << 18
SHARDS = 8
TRAIN_ROWS = 8192
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Length of a text's vector.
LENGTH = 6.0
THRESHOLD = 0.3
#: Buckets of the two markers.
REPEAT, SEEN = 1, 2

_CLASS = np.full(256, 3, np.uint8)
_CLASS[at.SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_SALT = [np.uint64(x) for x in (0x51ED270B7F3A4D1D, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that never trains."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every token."""
    kind = _CLASS[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    border[1:-1] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(border)
    starts, ends = cuts[:-1], cuts[1:]
    words = kind[starts] != 0
    starts, ends = starts[words], ends[words]
    return at.RollingHash(data).ranges(starts, ends), np.searchsorted(offsets, starts, "right") - 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _pairs(h: np.ndarray) -> np.ndarray:
    return at.mix(h[:-1] * _SALT[0] + h[1:])


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row << 18 | bucket keys, counts) of a few megabytes of texts."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, row = _tokens(data, offsets)
    if len(h) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = row[1:] == row[:-1]
    pairs = _pairs(h)
    again = (h[1:] == h[:-1]) & same
    keys = [row << 18 | _bucket(h), (row[1:] << 18 | _bucket(pairs))[same]]
    keys.append(row[1:][again] << 18 | REPEAT)
    if len(h) > 2:
        threes = at.mix(pairs[:-1] * _SALT[1] + h[2:] + row[2:].astype(np.uint64) * _SALT[2])[same[1:] & same[:-1]]
        owner = row[2:][same[1:] & same[:-1]]
        order = np.argsort(threes, kind="stable")
        seen = np.zeros(len(threes), bool)
        seen[order[1:]] = threes[order[1:]] == threes[order[:-1]]
        keys.append(owner[seen] << 18 | SEEN)
    return np.unique(np.concatenate(keys), return_counts=True)


def _long_buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The counts of one text's buckets, read in pieces."""
    total, before, triples, n_triples = np.zeros(DIM, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    for piece in _pieces(data, size):
        h, _ = _tokens(piece, np.array([0, len(piece)]))
        total += np.bincount(_bucket(h), minlength=DIM)
        h = np.concatenate([before, h])
        pairs = _pairs(h)
        fresh = max(0, len(before) - 1)  # the pair within what was carried is counted already
        total += np.bincount(_bucket(pairs[fresh:]), minlength=DIM)
        total[REPEAT] += int((h[1:] == h[:-1])[fresh:].sum())
        if len(h) > 2:
            threes = at.mix(pairs[:-1] * _SALT[1] + h[2:])
            n_triples += len(threes)
            triples = np.union1d(triples, threes)
        before = h[-2:]
    total[SEEN] += n_triples - len(triples)
    return total


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A text in parts of about ``size`` bytes that end at white space."""
    start = 0
    while start < len(data):
        stop = start + size
        while stop < len(data):
            gaps = np.flatnonzero(at.SPACE[data[stop : stop + 4096]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += 4096
        yield data[start:stop]
        start = stop


def features(texts: pa.Array, size: int = at.SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets, values): row r has the sparse vector at offsets[r]:offsets[r + 1], of length LENGTH or empty."""
    data, offsets = at.bytes_of(texts)
    n = len(offsets) - 1
    if len(data) <= size or n > 1:  # slices hold several rows only up to their size
        keys, counts = _buckets(data, offsets)
    else:
        total = _long_buckets(data, size)
        keys = np.flatnonzero(total)
        counts = total[keys]
    row, values = keys >> 18, np.log1p(counts)
    values *= LENGTH / np.sqrt(np.bincount(row, values**2, n))[row]
    return np.searchsorted(keys, np.arange(n + 1) << 18), keys & (DIM - 1), values


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of accumulated gradients z and squares n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of updates in place; the last place of z and n is the bias."""
    for index, value, label in rows:
        zi, ni = z[index], n[index]
        w = weights_of(zi, ni)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        grown = ni + g * g
        z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
        n[index] = grown


class Model:
    """Weights of DIM buckets and a bias."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        offsets, index, value = features(texts)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        return 1 / (1 + np.exp(-np.clip(np.bincount(rows, self.weights[index] * value, len(texts)) + self.weights[DIM], -35, 35)))


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of all groups (``SHARDS`` at most) as one, weighted by their rows, in the groups' order whatever that of arrival."""
    states = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda s: s["shard"])
    if states:
        total = sum(s["rows"] for s in states)
        means = [sum(np.frombuffer(s[c], "<f4").astype(float) * (s["rows"] / total) for s in states) for c in ("z", "n")]
        yield pa.RecordBatch.from_arrays([pa.array([m.astype("<f8").tobytes()]) for m in means], ["z", "n"])


def _packed(rows):
    """A group's rows as one: vectors back to back, in an order that depends on the rows alone."""
    ids, labels, index, value = (rows[c].to_pylist() if c in ("id", "y") else rows[c] for c in ("id", "y", "index", "value"))
    order = sorted(range(len(ids)), key=lambda k: (ids[k] * 0x9E3779B1 & 0xFFFFFFFF, ids[k], len(index[k]), labels[k]))
    vectors = [(index[k].values.to_numpy().astype("<i4"), value[k].values.to_numpy().astype("<f4")) for k in order]
    blobs = np.array([labels[k] for k in order], "<i4").tobytes(), np.array([len(i) for i, _ in vectors], "<i8").tobytes(), b"".join(i.tobytes() for i, _ in vectors), b"".join(v.tobytes() for _, v in vectors)
    return pa.table({"shard": [rows["shard"][0].as_py()], "rows": [len(ids)]} | dict(zip(("y", "sizes", "index", "value"), ([b] for b in blobs), strict=True)))


def _unpacked(shard: dict, epoch: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The vectors of a group, with the bias as one more bucket, in another order each epoch."""
    labels, ends = np.frombuffer(shard["y"], "<i4"), np.cumsum(np.frombuffer(shard["sizes"], "<i8"))
    index, value = np.frombuffer(shard["index"], "<i4"), np.frombuffer(shard["value"], "<f4")
    for k in np.random.default_rng(epoch).permutation(len(labels)).tolist():
        a, b = ends[k - 1] if k else 0, ends[k]
        yield np.append(index[a:b], DIM), np.append(value[a:b], np.float32(1)), int(labels[k])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from the at most ``train_rows`` labelled rows, outside the held-out fifth, with the smallest id hashes.

    The chosen ids (16 bytes each) are small enough to broadcast whatever the tables' sizes."""
    spark = documents.sparkSession
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(train_rows)
    )
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in at.slices(batch.select(["id", "text", "y"]), "text"):
                offsets, index, value = features(text)
                arrays = [part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(index, pa.int32())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value, pa.float32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "y", "index", "value"])

    sparse = texts.mapInArrow(vectors, f"id {dict(documents.dtypes)['doc_id']}, y int, index array<int>, value array<float>")
    # of rows that share an id one trains, however many there are
    sparse = sparse.groupBy("id", "y").agg(F.min(F.struct("index", "value")).alias("v")).select("id", "y", "v.*")
    sparse = sparse.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS)))
    shards = cut(sparse.groupBy("shard").applyInArrow(_packed, "shard long, rows long, y binary, sizes binary, index binary, value binary"), SHARDS)
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    z, n = (x.copy() for x in state.value)
                    ftrl(_unpacked(row, epoch), z, n)
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), pa.array([row["rows"]]), pa.array([z.astype("<f4").tobytes()]), pa.array([n.astype("<f4").tobytes()])], ["shard", "rows", "z", "n"])

        states = shards.mapInArrow(learned, "shard long, rows long, z binary, n binary").repartition(1)
        for row in states.mapInArrow(_averaged, "z binary, n binary").collect():
            z, n = (np.frombuffer(row[c], "<f8") for c in ("z", "n"))
        state.unpersist()
    return Model(weights_of(z, n))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        for batch in batches:
            for part, text in at.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(text))], ["doc_id", "score"])

    rows = documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        for batch in batches:
            for part, text in at.slices(batch, "text"):
                yield part.filter(pa.array(own.scores(text) >= threshold))

    return documents.mapInArrow(kept, documents.schema)


def quality_scores(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on ``labels`` and scores every document."""
    return score(documents, train(documents, labels))
