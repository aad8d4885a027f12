"""Approximate nearest neighbours by a hash-prefix forest, for cosine.

A tree is the rows' hash strings in order: ``BITS`` signs of projections on random directions, which are orthogonal within a tree. Rows near
each other share longer prefixes. A search has two phases. Descending, a query goes to its place in every tree's sorted array, where the
rows with the longest common prefixes lie on both sides; the best of these are known by exact cosine. Ascending, all trees
go up together to shorter prefixes, and every row that shares the prefix in some tree is compared exactly.

How far to ascend follows from what the descent found. Two vectors of cosine c agree in a bit with probability p = 1 - arccos(c) / pi, so a row as near
as the k-th best so far stays unseen in all ``TREES`` trees at prefix length x with probability (1 - p^x)^TREES. The ascent ends at the longest prefix at which
this is at most ``MISS``; with fewer than k found it goes up to the root, so that small tables are searched whole. The work follows the
data: near neighbours are found under long prefixes, and only queries without any compare with many rows. No number of candidates is set.

Rows are dealt to blocks of at most about ``BLOCK`` rows, and every block sorts its own share of each tree. As all blocks use the same directions and
a query's prefix length is the same in all, they hold together what one forest of all rows would. Queries, a stated set, go to every
block in groups of about ``BLOCK``, and each block returns k rows a query. Nothing is collected or broadcast.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different lengths aren't compared; a
null id is no query, and comes last among equal scores; every row but the query's own is a candidate, so copies of it are, and a row repeated with
its id is a query of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import ranges
from .shared import cut, stored

TREES, BITS = 128, 32
#: The chance that a row as near as the k-th best is missed.
MISS = 0.05
NEAREST, EVERY = 5, 50
#: Rows that a query looks at on either side of its place in a tree, in each block.
BESIDE = 4
BLOCK, LEAST_BLOCKS = 1 << 15, 24
SEED = 5


def directions(length: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(length, trees * bits): orthogonal directions within a tree, as far as the length allows."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(trees):
        own: list[np.ndarray] = []
        while sum(o.shape[1] for o in own) < bits:
            own.append(np.linalg.qr(rng.standard_normal((length, length)))[0])
        out.append(np.concatenate(own, axis=1)[:, :bits])
    return np.concatenate(out, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that no square overflows or vanishes; cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of q with every row of x, each summed alike, so that equal rows have equal values."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def hash_strings(x: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(trees, rows): the strings as numbers, the first bit the highest."""
    planes, place = directions(x.shape[1], trees, bits), (np.uint64(1) << np.arange(bits, dtype=np.uint64)[::-1])
    out = np.empty((trees, len(x)), np.uint64)
    for k in range(0, len(x), 8192):
        sign = (x[k : k + 8192] @ planes > 0).reshape(-1, trees, bits)
        out[:, k : k + 8192] = (sign * place).sum(axis=2, dtype=np.uint64).T
    return out


class Forest:
    """The sorted arrays of a block's rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows = scaled(x), ids, rows
        self.unit = self.x / np.sqrt((self.x * self.x).sum(axis=1))[:, None]
        keys = hash_strings(self.x)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        self.flat, self.first = self.order.ravel(), np.arange(TREES) * len(x)

    def beside(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): the range of places next to each query's."""
        at = np.stack([np.searchsorted(k, s) for k, s in zip(self.keys, strings, strict=True)])
        return np.maximum(at - BESIDE, 0), np.minimum(at + BESIDE, len(self.x))

    def under(self, strings: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): the range of places that share a prefix of the query's length."""
        rest = (np.uint64(1) << (BITS - levels).astype(np.uint64)) - np.uint64(1)
        low = np.stack([np.searchsorted(k, s) for k, s in zip(self.keys, strings & ~rest, strict=True)])
        return low, np.stack([np.searchsorted(k, s, "right") for k, s in zip(self.keys, strings | rest, strict=True)])

    def best(self, q: np.ndarray, own_row: int, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k nearest within the ranges of one query, and of those equal to the k-th the ones with the least ids."""
        seen = np.zeros(len(self.x), bool)
        seen[self.flat[ranges(low + self.first, high - low)]] = True
        found = np.flatnonzero(seen & (self.rows != own_row))
        if len(found) > k:  # roughly first, so that few are summed with care
            rough = self.unit[found] @ (q / np.sqrt((q * q).sum()))
            found = found[rough >= np.partition(rough, -k)[-k] - 1e-9]
        scores = cosines(self.x[found], q)
        order = np.lexsort((self.ids[found], -scores))[:k]
        return found[order], scores[order]


_FOUND = "query long, query_id long, row long, vec_id long, score double"


def _search(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    empty = pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in ("query", "query_id", "row", "vec_id", "score")})
    if not rows.num_rows or not queries.num_rows:
        return empty
    vectors = lambda t: np.array(t["vector"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    ids = rows["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    forest = Forest(vectors(rows), ids, rows["row"].to_numpy())
    queries = queries.rename_columns([c.removeprefix("q_") for c in queries.column_names])
    q = scaled(vectors(queries))
    strings, own = hash_strings(q), queries["row"].to_numpy()
    levels = queries["level"].to_numpy() if "level" in queries.column_names else None
    low, high = forest.beside(strings) if levels is None else forest.under(strings, levels)
    got = [forest.best(q[i], own[i], low[:, i], high[:, i], k) for i in range(len(q))]
    of, places = np.repeat(np.arange(len(q)), [len(p) for p, _ in got]), np.concatenate([p for p, _ in got])
    return pa.table({"query": own[of], "query_id": queries["vec_id"].take(pa.array(of)), "row": forest.rows[places], "vec_id": rows["vec_id"].take(pa.array(places)), "score": np.concatenate([s for _, s in got])})


def prefix_length(score: Column) -> Column:
    """The longest prefix at which a row of this cosine is missed with a probability of at most MISS."""
    seen = math.log(1 - MISS ** (1 / TREES))  # the least logarithm of p^x
    agree = 1 - F.acos(F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))) / math.pi
    return F.when(agree >= math.exp(seen / BITS), BITS).when(agree <= 0, 0).otherwise(F.floor(seen / F.ln(agree))).cast("long")


def _top(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row whose id is divisible by ``every``."""
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = sound.where(~bad & F.exists("vector", lambda v: v != 0))
    sound = stored(sound.withColumns({"row": F.monotonically_increasing_id(), "length": F.size("vector")}))
    n, asked = sound.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, groups = max(-(-n // BLOCK), min(LEAST_BLOCKS, -(-n // 256)), 1), max(1, -(-asked // BLOCK))
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    all_of = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = all_of(deal(sound, blocks, "block"), groups, "part").groupBy("length", "block", "part")

    def search(queries: DataFrame) -> DataFrame:
        sent = all_of(deal(queries, groups, "part"), blocks, "block").withColumnsRenamed({c: f"q_{c}" for c in (*queries.columns, "block", "part")}).groupBy("q_length", "q_block", "q_part")
        return _top(rows.cogroup(sent).applyInArrow(lambda a, b: _search(a, b, k), _FOUND), k, ["query"])

    queries = sound.where(F.col("vec_id") % every == 0)
    descended = cut(search(queries))
    known = descended.where(F.col("rank") == k).select(F.col("query").alias("row"), prefix_length(F.col("score")).alias("level"))
    ascended = search(queries.join(known, "row", "left").withColumn("level", F.coalesce("level", F.lit(0).cast("long"))))
    both = descended.unionByName(ascended).drop("rank").dropDuplicates(["query", "row"])
    return _top(both, k, ["query"]).select("query_id", "rank", "vec_id", "score")
