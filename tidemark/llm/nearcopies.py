"""Near copies: texts whose sets of five-word shingles have a Jaccard coefficient of ``LIKE`` or more, found by SimHash.

Words are those of ``simhash``: A-Z lower-cased, runs of bytes other than 0x20 and 0x09-0x0D; fewer than ``SHINGLE`` words form one
shingle. Rows with equal sets are one node, whatever their number. A node has ``SEEDS`` fingerprints, each the SimHash of its shingles hashed anew. Each
is searched by ``simhash``'s generalised pigeonhole (parts of correlated bits, thresholds by dynamic programming, probing), laid out so that all within
``DISTANCE`` bits meet. Those that meet, differ in at most ``REACH`` bits and in ``ALL`` a fingerprint over all their fingerprints count as near copies only after their sets are compared in full, so
none is wrong. Before that, pairs that can't be near copies are told by ``ODD`` parities of each set (of how many of its hashes fall into each of so many
cells): sets differ in at least as many hashes as parities, so no near copy is lost, and the sets of few other pairs have to travel. Some are missed: the bits of two texts of coefficient j differ by 64 / pi * arccos(2 j / (1 + j)) on average, 9.7 at 0.8, so one
fingerprint's search finds a part of them; but the fingerprints are independent, and what all of them miss is little. The README has the measured share.

Components are found in two rounds. In the first, one node of each part's value (a leader, by a hash) meets the others of that value, so its pairs are
in proportion to the nodes. In the second all pairs of one value meet that are still in different components, so no leader's choice
decides a result. Of these pairs those within ``CLOSE`` bits are compared first, and then the others that they left in different components, so
that a group of like texts, connected by then, isn't compared pair by pair. Only ids meet; sets join the pairs that are left, by shuffles. Texts are dealt out only where a mask of hashed ids
(``shared.split``) can't tell that they aren't needed.

Edge cases: null and wordless texts have the empty set, one node; rows with a null id connect nothing; repeated rows are one node; a very long text is
hashed in pieces, its set held by one task; extra columns are ignored by the search and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from . import simhash
from .components import components
from .shared import cut, split
from .simhash import STEP, _hashes, _words

SHINGLE = 5
#: Least Jaccard coefficient of near copies, as a fraction of whole numbers.
LIKE = (4, 5)
#: Fingerprints of a set; bits within which all that differ meet, by which those that met may differ, and by which mostly near copies differ.
SEEDS, DISTANCE, REACH, CLOSE = 4, 5, 11, 4
#: Bits a fingerprint by which those that met may differ on average over all of a set's; texts of coefficient 0.8 pass 13 with a chance of 0.99.
ALL = 13
#: Parities of a set, a multiple of 64.
ODD = 512
#: Rows of the table of nodes that a task holds on average.
TASK_NODES = 10_000


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found, rest = [], []
    for words in _words(text.lower()):
        words = rest + words
        for k in range(0, len(words) - SHINGLE + 1, STEP):
            found.append(np.array(_hashes(words[k : k + STEP + SHINGLE - 1], SHINGLE), np.uint64))
        rest = words[-(SHINGLE - 1) :]
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(rest), 42)] if rest else [], np.uint64)
    return np.unique(np.concatenate(found))


def fingerprint(hashes: np.ndarray, seed: int = 0) -> int:
    """The SimHash of a set whose hashes are mixed with a seed; 0 for the empty one."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        own = hashes[k : k + STEP]
        if seed:
            own = at.mix(own * np.uint64(2 * seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1) + np.uint64(seed))
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << simhash._BITS).sum())


def digest(hashes: np.ndarray) -> int:
    """One number for a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of ``ODD`` cells whether an odd number of the set's hashes falls into it, as 64-bit numbers."""
    odd = np.bincount((hashes % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, fps, odd, size) of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in at.text_array(batch.column(2))]
            sets = [shingles(t) for t in texts]
            nodes = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
            fps = np.array([[fingerprint(s, k) for k in range(SEEDS)] for s in sets], np.uint64).view(np.int64)
            sketches = [pa.array(list(fps), pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), *sketches], ["doc_id", "text_hash", "node", "fps", "odd", "size"])

    return documents.select("doc_id", F.xxhash64("text"), "text").mapInArrow(sketched, f"doc_id {dict(documents.dtypes)['doc_id']}, text_hash long, node long, fps array<long>, odd array<long>, size long")


def _sets(documents: DataFrame) -> DataFrame:
    """(node, hashes) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                sets = [shingles(t.as_buffer().to_pybytes()) for t in texts]
                nodes = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    return documents.select("text").mapInArrow(hashed, "node long, hashes array<long>")


def _confirmed(pairs: DataFrame, documents: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near copies. Only the texts of the pairs' nodes are hashed again, and few others are dealt out to meet them."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = cut(met.join(first, "node").select("doc_id").distinct())
    texts = split(documents, ids, ["doc_id"])[0].join(ids, "doc_id", "left_semi")  # a doc_id may have rows of several texts
    sets = cut(_sets(texts).join(met, "node", "left_semi").dropDuplicates(["node"]))
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(LIKE[1] * both >= LIKE[0] * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose fingerprints differ in at most SEEDS * ALL bits in all, and whose sets can be near copies by their sizes and parities: sets of
    that likeness differ in at most ``most`` hashes. Only sketches travel, so that few sets have to."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.struct("fps", "odd", "size").alias(f"of_{end}")), end)
    differ = lambda c, n: reduce(lambda x, y: x + y, (F.bit_count(F.get(f"of_a.{c}", F.lit(k)).bitwiseXOR(F.get(f"of_b.{c}", F.lit(k)))) for k in range(n)))
    most = (F.col("of_a.size") + F.col("of_b.size")) * (LIKE[1] - LIKE[0]) / sum(LIKE)
    least = F.greatest(F.abs(F.col("of_a.size") - F.col("of_b.size")), differ("odd", ODD // 64))
    return pairs.where((differ("fps", SEEDS) <= SEEDS * ALL) & (least <= most)).drop("of_a", "of_b")


def _layouts(nodes: DataFrame) -> list[list[tuple[list[int], int]]]:
    """Of each fingerprint the parts that it is searched by."""
    sample = [r["fps"] for r in nodes.select("fps").orderBy(F.xxhash64("fps"), "fps").limit(simhash.SAMPLE).collect()]
    seen, total = np.array(sample or [[0] * SEEDS], np.int64).view(np.uint64), nodes.count()
    return [simhash.layout(seen[:, k], total, DISTANCE) for k in range(SEEDS)]


def _entries(nodes: DataFrame, layouts: list[list[tuple[list[int], int]]]) -> DataFrame:
    """The nodes' columns without fps, with fp, part, value and own: what each fingerprint's parts enter and probe."""
    kept = [c for c in nodes.columns if c != "fps"]
    out = []
    for k, parts in enumerate(layouts):
        own = simhash.entered(nodes.select(*kept, F.get("fps", F.lit(k)).alias("fp")), parts)
        out.append(own.withColumn("part", F.col("part") + k * 64))
    return reduce(DataFrame.unionByName, out)


def _with_roots(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs with a_root and b_root, by ``named`` (node, root), which has every node."""
    for end in "ab":
        pairs = pairs.join(named.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
    return pairs


def _connected(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """``named`` (node, root) with the roots that pairs connect as one: only roots go through the rounds again, not all that was connected before."""
    links = components(_with_roots(pairs, named).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    return named.join(links.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))


def rooted(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, root) of the rows with a doc_id: rows of one root are connected by near copies."""
    rows = cut(_sketches(documents.where("doc_id is not null")))
    tasks = max(1, rows.count() // TASK_NODES)
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("fps", "odd", "size"))), tasks)
    layouts = _layouts(nodes)
    first = nodes.select("node", "doc_id")
    of = Window.partitionBy("part", "value")
    leader = F.min_by(F.struct("node", "fp"), F.xxhash64("node", "value")).over(of)
    # whom a probe alone finds is left to the second round
    led = _entries(nodes.select("node", "fps"), [[(bits, 0) for bits, _ in parts] for parts in layouts]).withColumn("l", leader).select("node", "fp", F.col("l.node").alias("b"), F.col("l.fp").alias("b_fp"))
    near = led.where((F.col("node") != F.col("b")) & (simhash.apart("fp", "b_fp") <= REACH))
    found = cut(_confirmed(cut(_likely(near.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), nodes)), documents, first))
    named = cut(nodes.select("node", "fps").join(components(found), "node", "left").select("node", "fps", F.coalesce("root", "node").alias("root")), tasks)
    # most nodes are their own root: an entry so has one number less
    entries = _entries(named.withColumn("root", F.expr("nullif(root, node)")), layouts)
    root = lambda s: F.coalesce(f"{s}_root", f"{s}_node")
    left, right = (entries.select("part", "value", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "fp", "root", "own"))) for s in "lr")
    # two own entries once; a probe meets those whose own it finds, be they smaller or greater
    once = ~F.col("r_own") & (F.col("l_node") != F.col("r_node")) | (F.col("l_node") < F.col("r_node"))
    met = left.where("l_own").join(right, ["part", "value"]).where(once & (root("l") != root("r")) & (simhash.apart("l_fp", "r_fp") <= REACH))
    pair = met.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"), simhash.apart("l_fp", "r_fp").alias("d"))
    rest = cut(_likely(pair.groupBy("a", "b").agg(F.min("d").alias("d")), nodes))
    close = cut(_confirmed(rest.where(F.col("d") <= CLOSE).select("a", "b"), documents, first))
    named = cut(_connected(named.select("node", "root"), close), tasks)
    far = cut(_with_roots(rest.where(F.col("d") > CLOSE), named).where("a_root <> b_root").select("a", "b"))
    return rows.select("doc_id", "text_hash", "node").join(_connected(named, _confirmed(far, documents, first)), "node")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component of near copies with all its columns, that with the smallest doc_id (of several texts with that id
    the one with the smallest hash; of rows equal in both any one, as they are copies).

    Rows with a null doc_id stay and connect nothing."""
    rows = cut(rooted(documents).select("doc_id", "text_hash", "root"))
    kept = cut(rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*").distinct())
    keys = ["doc_id", "text_hash"]
    # texts of rows that are neither dropped nor repeated stay where they are
    known = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), keys, "left")
    keyed = documents.where("doc_id is not null").select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    may, stay = split(keyed, known.where("n > 1 or kept is null").select(*keys), keys)
    found = may.join(kept, keys, "left_semi").dropDuplicates(keys)
    return stay.unionByName(found).select("row.*").unionByName(documents.where("doc_id is null"))
