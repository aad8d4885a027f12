"""Chains of rows: each row names the row that follows if it is reached, and the rows reached from a beginning are found side by side.

Rows of a key are numbered and cut into blocks of ``BLOCK``. Within a block, read from its end, every row learns where the chain
through it leaves the block; so a chain becomes a chain of block entries, far shorter, which is followed by pointer doubling: after k rounds all entries
within 2^k blocks of the beginning are known. The blocks that were entered then mark their own rows. No key is one task's work, and the rounds
are the logarithm of the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.sources.shared import stored

BLOCK = 512
#: Chunks of time in which rows are numbered side by side, in microseconds.
DAY = 86_400_000_000


def numbered(df: DataFrame, keys: list[str], order: list[str], at: str, chunk: int = DAY, name: str = "row") -> DataFrame:
    """``df`` with each key's rows numbered from 0 in the order, which begins with the number ``at``."""
    out = series.running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, at, chunk, {name: ("sum", "_one")})
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def _exits(nexts: Column, end: Column) -> Column:
    """Of a block's rows in order, where the chain through each leaves the block (null where it ends within): ``end`` is the row after the last."""

    def step(after: Column, nxt: Column) -> Column:
        # ``after`` holds the exits of the rows behind this one, the last of them at end - 1
        own = F.when(nxt >= end, nxt).otherwise(F.get(after, (nxt - (end - F.size(after))).cast("int")))
        return F.concat(F.array(own), after)

    return F.aggregate(F.reverse(nexts), F.array().cast("array<bigint>"), step)


def followed(df: DataFrame, keys: list[str], row: str, following: str, starts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(keys, row) of all rows that are reached from ``starts`` (keys, row; one a key) by way of ``following``: a greater row of the same key, or null
    at a chain's end. Rows are numbered from 0 without gaps; a ``following`` beyond the last ends the chain."""
    place = F.floor(F.col(row) / block).cast("long")
    blocks = df.groupBy(*keys, place.alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.col(row).cast("long").alias("r"), F.col(following).cast("long").alias("n")))).alias("_rows"))
    end = F.col("_b") * block + F.size("_rows")
    blocks = stored(blocks.withColumn("_out", _exits(F.transform("_rows", lambda x: x["n"]), end)), "chain-blocks")
    begin = starts.select(*keys, F.col(row).cast("long").alias("_at"))
    nodes = blocks.select(*keys, F.explode(F.array_distinct("_out")).alias("_at")).where("_at is not null").unionByName(begin).distinct()
    # where the chain through an entered row enters the next block
    jump = nodes.withColumn("_b", F.floor(F.col("_at") / block)).join(blocks, [*keys, "_b"]).select(*keys, "_at", F.get("_out", (F.col("_at") % block).cast("int")).alias("_to")).where("_to is not null")
    reached = stored(begin.distinct(), "chain-reached")
    jump = stored(jump, "chain-jumps")
    while True:
        more = reached.join(jump, [*keys, "_at"]).select(*keys, F.col("_to").alias("_at")).distinct().join(reached, [*keys, "_at"], "left_anti")
        more = stored(more, "chain-reached")
        if more.isEmpty():
            break
        reached = stored(reached.unionByName(more), "chain-reached")
        twice = jump.select(*keys, F.col("_at").alias("_from"), F.col("_to").alias("_at")).join(jump, [*keys, "_at"])
        jump = stored(twice.select(*keys, F.col("_from").alias("_at"), "_to"), "chain-jumps")
    entered = reached.withColumn("_b", F.floor(F.col("_at") / block)).join(blocks.select(*keys, "_b", "_rows"), [*keys, "_b"])

    def mark(seen: Column, x: Column) -> Column:
        here = seen["at"] == x["r"]
        return F.struct(F.when(here, F.coalesce(x["n"], F.lit(-1).cast("long"))).otherwise(seen["at"]).alias("at"), F.when(here, F.concat(seen["rows"], F.array(x["r"]))).otherwise(seen["rows"]).alias("rows"))

    first = F.struct(F.col("_at").alias("at"), F.array().cast("array<bigint>").alias("rows"))
    return entered.select(*keys, F.explode(F.aggregate("_rows", first, mark)["rows"]).alias(row))


def elapsed_sessions(events: DataFrame, keys: list[str], at: str, tie: str, length: int, closing: bool = False, chunk: int = DAY) -> DataFrame:
    """``events`` with session (from 1): a session begins at an event and is over ``length`` microseconds after it, whatever lies between;
    the next begins at the next event.

    The first event at or after the end begins the next session, or with ``closing`` is the session's last one, and the event after it begins the next."""
    if length <= 0:
        raise ValueError("a session's length must be positive")
    rows = stored(numbered(events, keys, [at, tie], at, chunk, "_row"), "session-events")
    # every row asks, at its session's end, for the first event from there on
    asks = rows.select(*keys, (F.col(at) + length).alias("_t"), F.lit(0).alias("_side"), F.col("_row").alias("_own"), F.lit(None).cast("long").alias("_event"))
    there = rows.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.col("_row").alias("_own"), F.col("_row").alias("_event"))
    found = series.latest(asks.unionByName(there), keys, ["_t", "_side", "_own"], "_t", chunk, {"_next": F.col("_event")}, ahead=True).where("_side = 0")
    links = found.select(*keys, F.col("_own").alias("_row"), (F.col("_next") + int(closing)).alias("_next"))
    begins = followed(links, keys, "_row", "_next", rows.where("_row = 0").select(*keys, "_row"))
    marked = rows.join(begins.withColumn("_begins", F.lit(1).cast("long")), [*keys, "_row"], "left")
    return series.running(marked, keys, ["_row"], "_row", 1_000_000, {"session": ("sum", "_begins")}).drop("_row", "_begins")
