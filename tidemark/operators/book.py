"""Order books from snapshots and deltas, and the features of a book's state, on DataFrame functions, and for short epochs in Arrow batches.

Messages have symbol, seq (their order), us, type ('snapshot' or 'delta', 'trade' optionally) and the sides bids and asks, arrays of
(price, size). A snapshot replaces the book, and keeps levels of size zero; a delta sets levels, and removes those of size zero; a trade's first
level holds its price.

A snapshot begins an epoch, within which messages are numbered. A level that is set at message s and set again at u lives in [s, u), and what a
message sees is the best of the lives that hold its number. So that no message meets all levels and no level all its messages, every
life is cut into at most two aligned blocks of each power of two messages: a message lies in one block of each power, a block's best level is found
once, and the two meet by equality. The work is in proportion to messages and updates times the logarithm of an epoch's messages.

Epochs of at most REPLAYED messages whose levels are all numbers are replayed instead, message by message, in Arrow batches of rows that Spark has dealt and sorted by epoch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators.asof import over_interval
from tidemark.sources.shared import stored

TICK = 0.01
#: Chunks of seq in which running values are accumulated side by side, and of rows for windows over messages.
CHUNK = 1_000_000
#: Blocks of at least 2^HIGH messages have COPIES copies.
HIGH, COPIES = 10, 64
#: Messages of an epoch that one task replays.
REPLAYED = 10_000
_SIDE = "array<struct<price: double, size: double>>"


def from_json(messages: DataFrame, symbol: str, order: str) -> DataFrame:
    """Messages of the JSON reader with numbers for strings, in the order of a column."""
    side = lambda c: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda l: F.struct(l[0].cast("double").alias("price"), l[1].cast("double").alias("size")))
    return messages.select(F.lit(symbol).alias("symbol"), F.col(order).alias("seq"), (F.col("ts") * 1000).alias("us"), "type", side(F.col("data.b")).alias("bids"), side(F.col("data.a")).alias("asks"))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with epoch (snapshots so far), pos (their number within it from 0, trades not counted), n (the epoch's number of messages) and whether it is short enough
    to be replayed.

    Numbers run in chunks of seq, so an epoch may be a symbol's whole tape; the table is stored, as everything else reads it several times."""
    snap, kept = F.col("type") == "snapshot", F.col("type") != "trade"
    marked = messages.withColumns({"_snap": snap.cast("long"), "_kept": kept.cast("long")})
    marked = series.running(marked, ["symbol"], ["seq"], "seq", CHUNK, {"epoch": ("sum", "_snap"), "_all": ("sum", "_kept")})
    marked = series.latest(marked, ["symbol"], ["seq"], "seq", CHUNK, {"_base": F.when(F.col("_snap") == 1, F.col("_all") - 1)})
    rows = stored(marked.withColumn("pos", F.col("_all") - F.coalesce("_base", F.lit(0)) - 1).drop("_snap", "_kept", "_all", "_base"), "book-messages")
    number = lambda x: x.isNotNull() & ~F.isnan(x)
    plain = lambda side: F.coalesce(F.forall(side, lambda l: l.isNotNull() & number(l["price"]) & number(l["size"])), F.lit(False))
    sizes = rows.groupBy("symbol", "epoch").agg(F.count_if(kept).alias("n"), F.count("*").alias("_rows"), F.bool_and((F.size("bids") + F.size("asks") <= REPLAYED) & plain(F.col("bids")) & plain(F.col("asks")) & F.coalesce(F.col("type").isin("snapshot", "delta", "trade"), F.lit(False))).alias("_plain"))
    sizes = sizes.select("symbol", "epoch", "n", ((F.col("_rows") <= REPLAYED) & F.col("_plain")).alias("short"))
    return rows.join(sizes, ["symbol", "epoch"])


class _Side:
    """One side of a replayed book: sizes by rank (the price, negative on the ask side, so that the best is the greatest) and the ranks in order."""

    def __init__(self, sign: int):
        self.sign = sign
        self.clear()

    def clear(self) -> None:
        self.sizes, self.ranks, self.depth, self.tops = {}, [], 0.0, None

    def set(self, price: float, size: float, keep_zero: bool) -> None:
        rank, self.tops = self.sign * price, None
        held = self.sizes.pop(rank, None)
        self.depth += size - (held or 0.0)
        if size or keep_zero:
            self.sizes[rank] = size
            if held is None:
                insort(self.ranks, rank)
        elif held is not None:
            del self.ranks[bisect_left(self.ranks, rank)]

    def best(self, levels: int) -> tuple[list[float], list[float]]:
        """Prices and sizes, found anew after a change."""
        if self.tops is None:
            ranks = self.ranks[: -levels - 1 : -1]
            self.tops = [self.sign * r for r in ranks], [self.sizes[r] for r in ranks]
        return self.tops


def _levels(column: pa.Array) -> tuple[list[int], list[float], list[float]]:
    """Offsets, prices and sizes of a column of levels."""
    flat = column.flatten()
    ends = column.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
    return [0, *ends], flat.field("price").to_pylist(), flat.field("size").to_pylist()


def _replay(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Depths and best levels after each message of batches that are sorted by symbol, epoch and seq."""
    level = pa.struct([("price", pa.float64()), ("size", pa.float64())])
    current, sides = None, (_Side(1), _Side(-1))
    for batch in batches:
        both = [_levels(batch.column(c)) for c in ("bids", "asks")]
        depth, ends, prices, sizes = ([], []), ([0], [0]), ([], []), ([], [])
        for i, (symbol, epoch, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("symbol", "epoch", "type")), strict=True)):
            if (symbol, epoch) != current:
                current = (symbol, epoch)
                for side in sides:
                    side.clear()
            for k, (side, (at, price, size)) in enumerate(zip(sides, both, strict=True)):
                if kind != "trade":
                    for j in range(at[i], at[i + 1]):
                        side.set(price[j], size[j], kind == "snapshot")
                best, held = side.best(levels)
                depth[k].append(side.depth)
                prices[k].extend(best)
                sizes[k].extend(held)
                ends[k].append(len(prices[k]))
        tops = [pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.StructArray.from_arrays([pa.array(prices[k], pa.float64()), pa.array(sizes[k], pa.float64())], fields=list(level))) for k in (0, 1)]
        kept = [c for c in batch.schema.names if c not in ("bids", "asks", "_k")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(d, pa.float64()) for d in depth), *tops], names=[*kept, "bid_depth", "ask_depth", "bid_levels", "ask_levels"])


def _replayed(messages: DataFrame, levels: int) -> DataFrame:
    """What ``_depths`` and ``_seen`` find for numbered messages, of short epochs: each is dealt to one task and replayed there."""
    rows = messages.select("symbol", "epoch", "seq", "us", "type", *(c for c in ("last_trade",) if c in messages.columns), "bids", "asks")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("bids", "asks"))
    # a window asks for whole epochs in order; a repartition by the keys of the join before it is left out, and the join may then leave rows where they lie
    dealt = rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "epoch").orderBy("seq")))
    out = dealt.mapInArrow(lambda batches: _replay(batches, levels), f"{kept}, bid_depth double, ask_depth double, bid_levels {_SIDE}, ask_levels {_SIDE}")
    return _with_imbalance(out)


def _with_imbalance(rows: DataFrame) -> DataFrame:
    total = F.col("bid_depth") + F.col("ask_depth")
    return rows.withColumn("imbalance", F.coalesce(series.safe_div(F.col("bid_depth") - F.col("ask_depth"), total), F.lit(0.0)))


def level_lives(messages: DataFrame) -> DataFrame:
    """One row a level that a message sets, of numbered messages: side, price, size, the change of the side's depth, and until, the number of
    the message that sets it next, or the epoch's end."""
    tagged = lambda c, name: F.transform(c, lambda l: F.struct(F.lit(name).alias("side"), l["price"].alias("price"), l["size"].alias("size")))
    both = F.concat(tagged(F.col("bids"), "bid"), tagged(F.col("asks"), "ask"))
    rows = messages.where("type in ('snapshot', 'delta')").select("symbol", "epoch", "seq", "pos", "n", "type", F.posexplode(both).alias("k", "l")).select("symbol", "epoch", "seq", "pos", "n", "type", "k", "l.*")
    rows = series.beside(rows, ["symbol", "epoch", "side", "price"], ["pos", "k"], "pos", CHUNK, {"_held": "size"}, {"_set": "pos"})
    lives = rows.withColumns({"until": F.coalesce("_set", "n"), "change": F.col("size") - F.coalesce("_held", F.lit(0.0))}).drop("_set", "_held")
    return stored(lives, "book-lives")


def _depths(messages: DataFrame, lives: DataFrame) -> DataFrame:
    per = lives.groupBy("symbol", "epoch", "pos").agg(F.sum(F.when(F.col("side") == "bid", F.col("change")).otherwise(0.0)).alias("bid"), F.sum(F.when(F.col("side") == "ask", F.col("change")).otherwise(0.0)).alias("ask"))
    own = F.col("type") != "trade"
    rows = messages.join(per, ["symbol", "epoch", "pos"], "left")
    rows = rows.withColumns({f"_{s}": F.coalesce(F.when(own, F.col(s)), F.lit(0.0)) for s in ("bid", "ask")})
    rows = series.running(rows, ["symbol", "epoch"], ["seq"], "seq", CHUNK, {f"{s}_depth": ("sum", f"_{s}") for s in ("bid", "ask")}).drop("_bid", "_ask")
    return _with_imbalance(rows).drop("bid", "ask")


def depths(messages: DataFrame) -> DataFrame:
    """Size on each side after every message, and the imbalance: running sums of the changes of single levels within an epoch."""
    rows = numbered(messages)
    return _depths(rows, level_lives(rows)).select("symbol", "seq", "us", "bid_depth", "ask_depth", "imbalance")


def _blocks(start: Column, end: Column) -> Column:
    """The aligned blocks (h, i), holding i * 2^h to (i + 1) * 2^h - 1, that make up [start, end)."""
    heights = F.sequence(F.lit(0), F.ceil(F.log2((end - start).cast("double"))).cast("int"))

    def at(h: Column) -> Column:
        size = F.pow(F.lit(2), h).cast("long")
        s, e = F.ceil(start / size), F.floor(end / size)
        left = F.when((s < e) & (s % 2 == 1), F.struct(h.alias("h"), s.cast("long").alias("i")))
        right = F.when((s < e) & (e % 2 == 1), F.struct(h.alias("h"), (e - 1).cast("long").alias("i")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(heights, at)))


def _seen(messages: DataFrame, lives: DataFrame, levels: int) -> DataFrame:
    """By symbol and seq: the best ``levels`` of each side that a message sees, arrays of (price, size), best first."""
    live = lives.where("until > pos and (size <> 0 or type = 'snapshot')")
    # asks by their negative price, so that the best of either side is the greatest
    rank = F.when(F.col("side") == "bid", F.col("price")).otherwise(-F.col("price"))
    cut = live.select("symbol", "epoch", "side", F.struct(rank.alias("r"), "size").alias("l"), F.explode(_blocks(F.col("pos"), F.col("until"))).alias("b")).select("symbol", "epoch", "side", "l", "b.*")
    node, of = ["symbol", "epoch", "h", "i"], {x: F.when(F.col("side") == x, F.col("l")) for x in ("bid", "ask")}
    if levels == 1:
        best = cut.groupBy(*node).agg(*(F.max(c).alias(x) for x, c in of.items()))
    else:
        ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy(*node, "side").orderBy(F.desc("l")))).where(F.col("k") <= levels)
        best = ranked.groupBy(*node).agg(*(F.collect_list(c).alias(x) for x, c in of.items()))  # ``levels`` at most
    # a block of many messages is repeated, and each of them meets one of its copies
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("h") >= HIGH, COPIES - 1).otherwise(0))))
    block = lambda h: F.struct(h.alias("h"), F.floor(F.col("pos") / F.pow(F.lit(2), h)).cast("long").alias("i"), F.when(h >= HIGH, F.pmod("pos", F.lit(COPIES))).otherwise(0).cast("int").alias("copy"))
    heights = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest("n", F.lit(1)).cast("double"))).cast("int")), block)
    asks = messages.where("pos >= 0").select("symbol", "epoch", "seq", F.explode(heights).alias("b")).select("symbol", "epoch", "seq", "b.*")
    met = asks.join(best, ["symbol", "epoch", "h", "i", "copy"])
    if levels == 1:
        found = met.groupBy("symbol", "seq").agg(*(F.array_compact(F.array(F.max(x))).alias(x) for x in of))
    else:  # a list a power of two, of ``levels`` each
        found = met.groupBy("symbol", "seq").agg(*(F.slice(F.sort_array(F.flatten(F.collect_list(x)), asc=False), 1, levels).alias(x) for x in of))
    priced = lambda x, sign: F.transform(x, lambda l: F.struct((l["r"] * sign).alias("price"), l["size"].alias("size")))
    return found.select("symbol", "seq", priced("bid", 1).alias("bid_levels"), priced("ask", -1).alias("ask_levels"))


def _padded(levels: Column, n: int, sign: int, other: Column, tick: float) -> Column:
    """Missing levels a tick apart with size 0; an empty side's padding begins two ticks from the other side's best price, the last trade or 1000."""
    held = F.coalesce(levels, F.array().cast(_SIDE))
    edge = F.when(F.size(held) > 0, F.element_at(held, F.size(held))["price"]).otherwise(F.coalesce(other, F.col("last_trade"), F.lit(1000.0)) + sign * tick)
    pads = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((edge + sign * tick * k).alias("price"), F.lit(0.0).alias("size")))
    return F.slice(F.concat(held, pads), 1, n)


def states(messages: DataFrame, levels: int = 0, tick: float = TICK) -> DataFrame:
    """After each message: best prices and sizes, mid (the last trade's price while a side is empty), spread, micro price, depths, imbalance
    and the top ``levels`` of both sides, padded."""
    trade = F.coalesce(F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"])
    rows = series.latest(messages, ["symbol"], ["seq"], "seq", CHUNK, {"last_trade": F.when(F.col("type") == "trade", trade)})
    rows = numbered(rows)
    short = _replayed(rows.where("short"), max(1, levels))
    rows = rows.where("not short")
    lives = level_lives(rows)
    rows = _depths(rows, lives).join(_seen(rows, lives, max(1, levels)), ["symbol", "seq"], "left")
    rows = short.unionByName(rows.select(*short.columns))
    best = {"bid": F.get("bid_levels", F.lit(0)), "ask": F.get("ask_levels", F.lit(0))}
    rows = rows.withColumns({f"best_{s}": b["price"] for s, b in best.items()} | {f"{s}_size": F.coalesce(b["size"], F.lit(0.0)) for s, b in best.items()})
    rows = rows.withColumns({"mid": F.coalesce((F.col("best_bid") + F.col("best_ask")) / 2, "last_trade"), "spread": F.col("best_ask") - F.col("best_bid")})
    micro = series.safe_div(F.col("best_bid") * F.col("ask_size") + F.col("best_ask") * F.col("bid_size"), F.col("bid_size") + F.col("ask_size"))
    tops = {"bids": _padded(F.col("bid_levels"), levels, -1, F.col("best_ask"), tick), "asks": _padded(F.col("ask_levels"), levels, 1, F.col("best_bid"), tick)} if levels else {}
    rows = rows.withColumns({"micro": F.coalesce(micro, "mid")} | tops)
    return rows.select("symbol", "seq", "us", "type", "best_bid", "best_ask", "bid_size", "ask_size", "mid", "spread", "micro", "bid_depth", "ask_depth", "imbalance", *tops)


def _log_return(now: Column, before: Column) -> Column:
    """ln(now / before) in IEEE arithmetic: from or to a price of zero it is infinite, from zero to zero not a number, and so is a deviation over it."""
    inf = F.lit(float("inf"))
    zero = F.when((now == 0) & (before == 0), F.lit(float("nan"))).when(now == 0, -inf).otherwise(inf)
    return F.when((now == 0) | (before == 0), F.when(now.isNotNull() & before.isNotNull(), zero)).otherwise(F.ln(series.safe_div(now, before)))


def order_flow(df: DataFrame, trades: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """``df`` (symbol, us) with ofi_<k>: imbalance of the trades of the last k * 100 ms, 0 without trades."""
    rows = trades.select("symbol", "us", F.when(F.col("is_buyer_maker"), 0.0).otherwise(F.col("quantity")).alias("b"), F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0).alias("s"))
    # the interval's left edge belongs to it
    df = over_interval(df, rows, ["symbol"], "us", {f"_{c}{k}": ("sum", c, k * 100_000 + 1) for k in periods for c in "bs"})
    flow = {f"ofi_{k}": F.coalesce(series.safe_div(F.col(f"_b{k}") - F.col(f"_s{k}"), F.col(f"_b{k}") + F.col(f"_s{k}")), F.lit(0.0)) for k in periods}
    return df.withColumns(flow).drop(*(f"_{c}{k}" for k in periods for c in "bs"))


def market_features(states_: DataFrame, periods: tuple[int, ...] = (10, 50, 100), trades: DataFrame | None = None) -> DataFrame:
    """Per message: volatility of the last k mids' log returns, mean imbalance of the last k, order-flow imbalance of the trades of
    the last k * 100 ms (0 without trades), and the time of day as sine and cosine."""
    day = 2 * 3.141592653589793 * (F.col("us") % 86_400_000_000) / 86_400_000_000
    df = states_.withColumns({"time_sin": F.sin(day), "time_cos": F.cos(day), "spread": F.coalesce("spread", F.lit(0.0))})

    def body(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows, added = rows.withColumn("_before", F.lag("mid").over(w)).withColumn("_lr", _log_return(F.col("mid"), F.col("_before"))).drop("_before"), {}
        for k in periods:
            frame, back = w.rowsBetween(-(k - 2), 0), w.rowsBetween(-(k - 1), 0)
            added[f"vol_{k}"] = F.when(F.count("mid").over(back) >= k, F.stddev_pop("_lr").over(frame)).otherwise(0.0)
            added[f"voi_{k}"] = F.when(F.count("imbalance").over(back) >= k, F.avg("imbalance").over(back)).otherwise(0.0)
        return rows.withColumns(added).drop("_lr")

    df = series.in_row_chunks(df, ["symbol"], ["seq"], "seq", CHUNK, 100_000, max(periods) + 1, body)
    if trades is None:
        return df.withColumns({f"ofi_{k}": F.lit(0.0) for k in periods})
    return order_flow(df, trades, periods)


def state_vector(features: DataFrame, length: int = 64, account: tuple[str, ...] = (), periods: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Adds vector, ``length`` numbers cut or filled with zeros: price over mid and size of each level (bids, then asks), the market features
    by the alphabet, and the ``account`` columns."""
    mid = F.when(F.coalesce("mid", F.lit(0.0)) == 0, 1.0).otherwise(F.col("mid"))
    market = {"mid_price": F.coalesce("mid", F.lit(0.0)), "spread": F.col("spread"), "micro_price": F.coalesce("micro", "mid", F.lit(0.0)), **{c: F.col(c) for c in ("bid_depth", "ask_depth", "time_sin", "time_cos", *(f"{k}_{p}" for k in ("vol", "ofi", "voi") for p in periods))}}
    flat = lambda c: F.flatten(F.transform(c, lambda l: F.array(l["price"] / mid, l["size"])))
    parts = F.concat(flat("bids"), flat("asks"), F.array(*(market[k] for k in sorted(market))), F.array(*(F.col(c).cast("double") for c in account)).cast("array<double>"))
    return features.withColumn("vector", F.slice(F.concat(parts, F.array_repeat(F.lit(0.0), length)), 1, length))


def history(df: DataFrame, keys: list[str], order: list[str], vector: str, n: int = 20) -> DataFrame:
    """Adds history: the last n vectors, the oldest repeated in front where there are fewer."""
    rows = series.rolled(df, keys, order, order[0], CHUNK, 100_000, n, {"_h": lambda w: F.collect_list(vector).over(w.rowsBetween(-(n - 1), 0))})
    return rows.withColumn("history", F.concat(F.array_repeat(F.get("_h", F.lit(0)), n - F.size("_h")), F.col("_h"))).drop("_h")


def markouts(fills: DataFrame, mids: DataFrame, steps: int = 10) -> DataFrame:
    """Adds markout: fill price against the mid ``steps`` - 1 messages later, positive where the price moved against the fill."""
    # the row steps - 1 later is steps - 1 rows back in descending order
    turned = mids.withColumn("_turn", -F.col("seq"))
    ahead = series.rolled(turned, ["symbol"], ["_turn"], "_turn", CHUNK, 100_000, steps, {"_later": lambda w: F.lag("mid", steps - 1).over(w)}).select("symbol", "seq", "_later")
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return fills.join(ahead, ["symbol", "seq"], "left").withColumn("markout", sign * (F.col("price") - F.col("_later"))).drop("_later")

