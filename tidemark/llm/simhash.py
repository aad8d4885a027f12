"""SimHash near-dedup by generalised pigeonhole.

Fingerprints: A-Z are lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D, every run of three
words (repeats included) is hashed with XXH64 (seed 42), and a bit of the fingerprint is set if it is set in over
half of the hashes.

Links: two fingerprints that differ in at most ``DISTANCE`` = 2 bits. The 64 bits are grouped into parts so that
correlated bits share a part, and each part gets a threshold t >= -1 with sum(t + 1) = DISTANCE + 1. Then any two
linked fingerprints are within t of each other in some part (if each part differed in at least t + 1 bits, the
whole would differ in at least DISTANCE + 1). A dynamic programme picks the thresholds with the least estimated
work (entries, probes of neighbouring values, candidates), and the number of parts with the least total. Grouping
and thresholds come from at most ``SAMPLE`` fingerprints; they set the cost alone, never which links are found.

Each distinct fingerprint enters its parts' values, and probes the values within the part's threshold. Where at
most ``BLOCK`` entries and probes share a value, they are compared pair by pair and verified. Where more do, no
pairs are made: two fingerprints are within two bits exactly if some value is within one bit of both, so each of
the block's fingerprints goes to its 65 such midpoints, and those that meet at a midpoint (65 at most) are linked.
That is as exact, and its work is in proportion to the block.

``nearcopies`` uses the same search with a wider distance to find texts that are then compared by their shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .components import components
from .shared import cut

SHINGLE = 3
DISTANCE = 2
SAMPLE = 2048
BLOCK = 64
#: Bits flipped at most in one part, and how many comparisons take as long as an entry, which is shuffled and sorted.
MOST_FLIPS, ENTRY = 2, 100
#: Words joined and hashed at a time, so that a very long text needs little memory.
STEP = 100_000
_BITS = np.arange(64, dtype=np.uint64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words in lists of bounded size; text of over 4 MB is cut at white space first."""
    if len(text) <= at.SLICE_BYTES:
        yield text.split()
        return
    start = 0
    while start < len(text):
        stop = min(len(text), start + at.SLICE_BYTES)
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield text[start:stop].split()
        start = stop


def _hashes(words: list[bytes], size: int) -> list[int]:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[s:e], 42) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint; 0 for a text without words. Fewer words than ``size`` form one shingle."""
    counts, total, rest = np.zeros(64, np.int64), 0, []
    for words in _words(text.lower()):  # bytes.lower() maps A-Z only
        words = rest + words
        for k in range(0, len(words) - size + 1, STEP):
            h = np.array(_hashes(words[k : k + STEP + size - 1], size), np.uint64)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        rest = words[-(size - 1) :]
    if total == 0:
        return xxhash.xxh64_intdigest(b" ".join(rest), 42) if rest else 0
    return int(((2 * counts > total).astype(np.uint64) << _BITS).sum())


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null text has no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = at.text_array(batch.column(1))
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(hashed, f"doc_id {dict(documents.dtypes)['doc_id']}, fp long")


# ---- grouping of bits and thresholds


def groups_of_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; a group takes the free bit most correlated with it."""
    bits = ((sample[:, None] >> _BITS) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits**2).mean(axis=0))
    corr = np.abs(bits.T @ bits / max(1, len(bits))) / np.maximum(np.outer(scale, scale), 1e-9)
    free, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def ball(width: int, t: int) -> int:
    """Values within ``t`` bits of one."""
    return sum(math.comb(width, k) for k in range(t + 1))


def thresholds(costs: list[dict[int, float]], units: int = DISTANCE + 1) -> tuple[list[int], float]:
    """A threshold t for each part, sum(t + 1) = units, with the least total cost: a dynamic programme over the parts."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (sofar, chosen) in best.items():
            for t, c in cost.items():
                key, value = used + t + 1, (sofar + c, [*chosen, t])
                if key <= units and (key not in step or value < step[key]):
                    step[key] = value
        best = step
    return best[units][1], best[units][0]


def layout(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every part in use, for ``total`` distinct fingerprints like the sample's."""
    sample = np.unique(sample)[:SAMPLE]
    reach = range(min(distance, MOST_FLIPS) + 1)
    choices = []
    for parts in range(2, max(4, distance) + 1):
        groups, costs = groups_of_bits(sample, parts), []
        if parts * len(reach) < distance + 1:
            continue
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            part = sample & mask
            near = np.zeros(len(reach))
            for k in range(0, len(part), 128):
                apart = np.bitwise_count(part[k : k + 128, None] ^ part[None, :])
                near += [(apart <= t).sum() for t in reach]
            pairs = max(1, len(part) * (len(part) - 1))
            share = np.maximum(near - len(part), 0) / pairs
            # an unseen coincidence counts as one between even values
            costs.append({-1: 0.0} | {t: total * ENTRY * (1 + ball(len(group), t)) + total * float(total) * max(share[t], ball(len(group), t) / 2.0 ** len(group)) / 2 for t in reach})
        chosen, cost = thresholds(costs, distance + 1)
        choices.append((cost, parts, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(choices)[2]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _flips(value: Column, bits: list[int], t: int) -> Column:
    """Array of the values within ``t`` flips of the given bits, the value itself left out."""
    masks = [_mask(c) for k in range(1, t + 1) for c in itertools.combinations(bits, k)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: value.bitwiseXOR(m))


def _probe(part: int):
    return lambda value: F.struct(F.lit(part).alias("part"), value.alias("value"), F.lit(False).alias("own"))


def apart(a: str, b: str, mask: int = -1) -> Column:
    """How many bits of two fingerprint columns differ, within a mask."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(mask)))


def planned(distinct: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The layout for the fingerprints in column fp."""
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    return layout(np.array(sample or [0], np.int64).view(np.uint64), distinct.count(), distance)


def entered(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``distinct`` with part, value and own: a row for each part's value of a fingerprint (own) and each value probed for it."""
    entries = []
    for k, (bits, t) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        entries.append(F.array(F.struct(F.lit(k).alias("part"), value.alias("value"), F.lit(True).alias("own"))))
        if t:
            entries.append(F.transform(_flips(value, bits, t), _probe(k)))
    return distinct.select(*distinct.columns, F.explode(F.concat(*entries)).alias("e")).select(*distinct.columns, "e.*")


def earlier(parts: list[tuple[list[int], int]], a: str, b: str) -> Column:
    """Whether two fingerprint columns that have met in column part have met in an earlier part as well."""
    return reduce(lambda found, p: found | (F.col("part") > p[0]) & (apart(a, b, _mask(p[1][0])) <= p[1][1]), enumerate(parts), F.lit(False))


def live(entries: DataFrame) -> DataFrame:
    """The entries that share their part's value with another, one of them its own, with their number n."""
    sizes = entries.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    return cut(entries.join(sizes.select("part", "value", "n"), ["part", "value"]))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints (column fp) within DISTANCE bits, directly or by way of others."""
    parts = planned(distinct, DISTANCE)
    shared = live(entered(distinct, parts))
    few, many = shared.where(F.col("n") <= BLOCK), shared.where(F.col("n") > BLOCK)
    left, right = few.where("own").select("part", "value", F.col("fp").alias("a")), few.select("part", "value", F.col("fp").alias("b"), "own")
    # each pair once: from its smaller end, in the first part that brings it together
    met = left.join(right, ["part", "value"]).where((F.col("a") < F.col("b")) & (apart("a", "b") <= DISTANCE) & ~earlier(parts, "a", "b")).select("a", "b")
    midpoints = many.select("fp").distinct().select("fp", F.explode(F.concat(F.array("fp"), _flips(F.col("fp"), list(range(64)), 1))).alias("mid"))
    hubs = midpoints.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    at_hubs = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return met.unionByName(at_hubs).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable over links).

    Edge cases: a null or wordless text has fingerprint zero, linked like any other; texts of fewer than three
    words form one shingle; repeated rows share a component, one output row each; a null doc_id takes part and
    is never a component_id unless all its component's are null; extra columns are ignored; an empty table gives
    no rows.
    """
    hashed = cut(fingerprints(documents))
    distinct = hashed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
