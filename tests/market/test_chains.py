import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, book, chains, crossing
from tidemark.operators.indicators import Settings


def reach(nexts, start):
    out, at = [], start
    while at is not None and at < len(nexts):
        out.append(at)
        at = nexts[at]
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_followed(spark, block):
    rng = random.Random(1)
    rows, starts, expected = [], [], set()
    for key, n in (("a", 300), ("b", 1), ("c", 57)):
        nexts = [None if rng.random() < 0.01 else i + rng.choice([1, 1, 2, 3, 9, 40]) for i in range(n)]
        rows += [(key, i, x) for i, x in enumerate(nexts)]
        start = rng.randrange(min(3, n))
        starts.append((key, start))
        expected |= {(key, i) for i in reach(nexts, start)}
    got = chains.followed(spark.createDataFrame(rows, "k string, row long, next long").repartition(3), ["k"], "row", "next", spark.createDataFrame(starts, "k string, row long"), block)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_nothing_to_follow(spark):
    empty = spark.createDataFrame([], "k string, row long, next long")
    assert chains.followed(empty, ["k"], "row", "next", empty.select("k", "row")).count() == 0


@pytest.mark.parametrize("closing", [False, True])
def test_elapsed_sessions(spark, closing):
    rng = random.Random(2)
    events = []
    for key in "ab":
        t = 0
        for i in range(400):
            t += rng.choice([0, 1, 1, 2, 5, 30])
            events.append((key, t, i))
    got = chains.elapsed_sessions(spark.createDataFrame(events, "k string, us long, id long").repartition(4), ["k"], "us", "id", 7, closing, chunk=50)
    expected, state = {}, {}
    for key, t, i in events:
        begin, number, over = state.get(key, (t, 0, True))
        if over or not closing and t - begin >= 7:
            begin, number = t, number + 1
        state[key] = (begin, number, closing and t - begin >= 7)
        expected[key, i] = number
    assert {(r["k"], r["id"]): r["session"] for r in got.collect()} == expected


@pytest.mark.parametrize("fan", [3, 64])
def test_first_at_most(spark, fan):
    rng = random.Random(3)
    values = [(k, i, rng.choice([None, float("nan"), *[rng.gauss(0, 1)] * 8]), rng.gauss(0, 1)) for k, n in (("a", 230), ("b", 5)) for i in range(n)]
    limits = [(rng.choice("abc"), j, rng.randrange(240), rng.choice([None, float("nan"), *[rng.gauss(-2, 1)] * 6]), rng.gauss(-3, 1)) for j in range(300)]
    got = crossing.first_at_most(spark.createDataFrame(limits, "k string, id long, since long, lx double, ly double"), spark.createDataFrame(values, "k string, row long, x double, y double"), ["k"], ["id"], "since", "row", {"x": "lx", "y": "ly"}, "found", fan)
    below = lambda v, l: v is not None and l is not None and v <= l
    expected = {(k, j): min((i for k2, i, x, y in values if k2 == k and i >= since and (below(x, lx) or below(y, ly))), default=None) for k, j, since, lx, ly in limits}
    assert {(r["k"], r["id"]): r["found"] for r in got.collect()} == expected
    assert len(expected) == 300


def test_first_at_most_without_values(spark):
    limits = spark.createDataFrame([("a", 1, 0, 1.0)], "k string, id long, since long, lx double")
    values = spark.createDataFrame([], "k string, row long, x double")
    assert crossing.first_at_most(limits, values, ["k"], ["id"], "since", "row", {"x": "lx"}, "found").collect()[0]["found"] is None


def test_one_series_fills_many_tasks(spark):
    """Many rows of one key against plain walks; the blocks of the key are dealt to several tasks."""
    n = 200_000
    rows = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("row"), (F.col("id") + 1 + F.xxhash64("id") % 5 % 5 + 5).alias("next"), F.sin(F.col("id").cast("double") / 1000).alias("x"))
    got = chains.followed(rows, ["k"], "row", "next", spark.createDataFrame([("a", 0)], "k string, row long"))
    nexts = {r["row"]: r["next"] for r in rows.select("row", "next").collect()}
    at, count = 0, 0
    while at in nexts:
        count, at = count + 1, nexts[at]
    assert got.count() == count
    limits = rows.where("row % 100 = 0").select("k", F.col("row").alias("id"), F.col("row").alias("since"), (F.col("x") - 0.5).alias("l"))
    found = {r["id"]: r["found"] for r in crossing.first_at_most(limits, rows, ["k"], ["id"], "since", "row", {"x": "l"}, "found").collect()}
    x = np.sin(np.arange(n) / 1000)
    for i in range(0, n, 4000):
        below = np.flatnonzero(x[i:] <= x[i] - 0.5 + 0.0)
        assert found[i] == (i + int(below[0]) if len(below) else None)


def walked(bars, s):
    """One symbol's bars in order through the position's state: (final_signal, entry, stop, target, trade, reason) of each."""
    out, last_exit, trades, terms, entered = [], -s.cooldown, 0, None, 0
    none = lambda v: v is None or v != v
    for i, (signal, high, low, close, atr, z, rsi) in enumerate(bars):
        if terms is None:
            if signal == 1 and i - last_exit >= s.cooldown:
                trades, entered = trades + 1, i
                terms = (close, None if none(atr) else close - s.stop_loss * atr, None if none(atr) else close + s.take_profit * atr)
                out.append((1, *terms, trades, ""))
            else:
                out.append((0, None, None, None, 0, ""))
            continue
        held, reason = i - entered >= s.min_hold, ""
        if not none(low) and not none(terms[1]) and low <= terms[1]:
            reason = "stop_loss"
        elif not none(high) and not none(terms[2]) and high >= terms[2]:
            reason = "take_profit"
        elif held and signal == 0:
            reason = "signal"
        elif held and (not none(z) and z > s.z_exit or not none(rsi) and rsi > s.rsi_exit):
            reason = "indicator_exit"
        if reason and held:
            out.append((0, *terms, trades, reason))
            terms, last_exit = None, i
        else:
            out.append((1, *terms, trades, ""))
    return out


BARS = "symbol string, us long, signal int, high double, low double, close double, atr double, z_score double, rsi double"


@pytest.mark.parametrize("settings", [Settings(min_hold=5, cooldown=15), Settings(min_hold=0, cooldown=0), Settings(min_hold=1, cooldown=1), Settings(min_hold=40, cooldown=3)])
def test_positions_against_a_walk(spark, settings):
    rng, rows = random.Random(7), []
    for symbol, n in (("a", 700), ("b", 90), ("c", 1)):
        price = 100.0
        for i in range(n):
            price += rng.gauss(0, 1)
            odd = lambda v: rng.choice([None, float("nan"), *[v] * 30])
            rows.append((symbol, i * 60_000_000, int(rng.random() < 0.6), price + abs(rng.gauss(0, 1)), price - abs(rng.gauss(0, 1)), price, odd(abs(rng.gauss(1, 1))), odd(rng.gauss(-2, 1)), odd(rng.gauss(40, 10))))
    got = backtest.positions(spark.createDataFrame(rows, BARS).repartition(4), settings).collect()
    expected = {}
    for symbol in "abc":
        own = [r for r in rows if r[0] == symbol]
        expected |= {(symbol, r[1]): w for r, w in zip(own, walked([r[2:] for r in own], settings), strict=True)}
    plain = lambda v: None if v is None or v != v else v
    found = {(r["symbol"], r["us"]): (r["final_signal"], plain(r["entry_price"]), plain(r["stop_price"]), plain(r["target_price"]), r["trade_id"], r["exit_reason"]) for r in got}
    assert found == expected and len(got) == len(rows)


def test_positions_of_one_long_series(spark, monkeypatch):
    monkeypatch.setattr(backtest, "ROWS", 2000)
    n = 100_000
    rows = spark.range(n).select(
        F.lit("a").alias("symbol"), (F.col("id") * 60_000_000).alias("us"), (F.xxhash64("id") % 3 == 0).cast("int").alias("signal"), (F.sin(F.col("id") / 50.0) * 5 + 101).alias("high"),
        (F.sin(F.col("id") / 50.0) * 5 + 99).alias("low"), (F.sin(F.col("id") / 50.0) * 5 + 100).alias("close"), F.lit(1.0).alias("atr"), F.lit(-1.0).alias("z_score"), F.lit(40.0).alias("rsi"))
    s = Settings()
    out = backtest.positions(rows, s).withColumn("task", F.spark_partition_id())
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in own.items():  # what is so small would be joined into one task or broadcast
        spark.conf.set(k, v)
    try:
        got = out.select("us", "final_signal", "trade_id", "exit_reason", "task").collect()
    finally:
        for k in own:
            spark.conf.unset(k)
    walk = walked([tuple(r)[2:] for r in rows.orderBy("us").collect()], s)
    assert [(r[1], r[2], r[3]) for r in sorted(got)] == [(w[0], w[4], w[5]) for w in walk]
    tasks = [r[4] for r in got]
    assert max(map(tasks.count, set(tasks))) < 0.7 * n


def test_a_book_of_one_snapshot(spark, monkeypatch):
    """One epoch over many chunks, with a level that is set again and again, against a plain walk."""
    monkeypatch.setattr(book, "CHUNK", 300)
    monkeypatch.setattr(book, "HIGH", 4)
    rng, rows, sides, expected = random.Random(9), [], ({}, {}), {}
    for seq in range(4000):
        price, size, side = float(rng.choice([50, 50, 50, *range(40, 60)])), float(rng.choice([0, 0, 1, 2, 3])), rng.randrange(2)
        price = price - 15 if side == 0 else price + 15
        levels = [(price, size)]
        rows.append(("a", seq, seq, "snapshot" if seq == 7 else "delta", levels if side == 0 else [], levels if side else []))
        if seq == 7:
            sides = ({}, {})
        if size or seq == 7:
            sides[side][price] = size
        else:
            sides[side].pop(price, None)
        expected[seq] = (max(sides[0], default=None), min(sides[1], default=None), sum(sides[0].values()), sum(sides[1].values()))
    schema = "symbol string, seq long, us long, type string, bids array<struct<price: double, size: double>>, asks array<struct<price: double, size: double>>"
    got = book.states(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert {r["seq"]: (r["best_bid"], r["best_ask"], r["bid_depth"], r["ask_depth"]) for r in got} == expected
