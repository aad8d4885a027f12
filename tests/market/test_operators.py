"""Hand fixtures: the properties that matter, each on a few rows."""

import json
import math
import random
import shutil
import statistics
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators import asof, backtest, book, candles, features, indicators, learning, paths, research
from tidemark.sources import market as sources

TICK = "symbol string, us long, price double, quantity double, trade_id long, is_buyer_maker boolean"


def bars_of(spark, rows):
    return spark.createDataFrame([("x", i * 60_000_000, *r) for i, r in enumerate(rows)], "symbol string, us long, open double, high double, low double, close double, volume double")


def test_candles_follow_time_and_id_whatever_the_partitions(spark):
    rows = [("x", 1, 5.0, 1.0, 1, True), ("x", 1, 7.0, 1.0, 2, True), ("x", 9, 6.0, 2.0, 3, False), ("x", 13_000_000, 1.0, 1.0, 5, True), ("x", 13_000_000, 2.0, 1.0, 4, True), ("x", 20_000_000, 3.0, 1.0, 6, True)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, TICK)
    results = [sorted(map(tuple, candles.candles(df.repartition(n), 13).collect())) for n in (1, 8)]
    assert results[0] == results[1] == [("x", 0, 1, 9, 5.0, 7.0, 5.0, 6.0, 4.0, 3), ("x", 13_000_000, 13_000_000, 20_000_000, 2.0, 3.0, 1.0, 3.0, 3.0, 3)]
    assert candles.totals(candles.candles(df, 13)).first()["all_valid"]


def test_constant_prices_give_no_nan(spark):
    df = indicators.indicators(bars_of(spark, [(5.0, 5.0, 5.0, 5.0, 1.0)] * 30))
    rows = df.orderBy("us").collect()
    assert all(r["z_score"] == 0 and r["rsi"] == 0 and r["adx"] == 0 and r["vwap"] == 5 for r in rows)
    assert indicators.indicators(bars_of(spark, [(5.0, 5.0, 5.0, 5.0, 1.0)] * 3), indicators.Settings(compat_rsi=True)).where("rsi <> 0").count() == 0


def test_vwap_restarts_each_day_and_equal_moves_both_survive(spark):
    rows = [("x", d * 86_400_000_000, 1.0, 1.0 + d, 1.0 - d, float(d + 1), 1.0) for d in range(3)]
    df = indicators.indicators(spark.createDataFrame(rows, "symbol string, us long, open double, high double, low double, close double, volume double"))
    got = df.orderBy("us").collect()
    assert [r["vwap"] for r in got] == [1.0, 2.0, 3.0]
    assert [(r["plus_dm"], r["minus_dm"]) for r in got[1:]] == [(1.0, 1.0), (1.0, 1.0)]


def path(spark, rows, **settings):
    """rows: (signal, high, low, close); atr 1, z and rsi neutral."""
    s = indicators.Settings(**settings)
    df = spark.createDataFrame([("x", i, *map(float, r[1:]), 1.0, -1.0, 0.0, r[0]) for i, r in enumerate(rows)], "symbol string, us long, high double, low double, close double, atr double, z_score double, rsi double, signal int")
    return backtest.positions(df, s)


def test_no_exit_before_the_holding_period_and_open_trades_are_left_out(spark):
    flat = (1, 10.5, 9.5, 10)
    out = path(spark, [flat, flat, (1, 10.5, 8.0, 9), flat, flat, (1, 10.5, 8.0, 9), flat], min_hold=5, cooldown=2).orderBy("us").collect()
    assert [r["final_signal"] for r in out] == [1, 1, 1, 1, 1, 0, 0]
    assert [r["exit_reason"] for r in out][5] == "stop_loss"
    assert backtest.trades(path(spark, [flat] * 4)).count() == 0


def test_cooldown_and_entry_at_the_first_bar(spark):
    off, on = (0, 10.5, 9.5, 10), (1, 10.5, 9.5, 10)
    out = path(spark, [on, off, on, on, on], min_hold=1, cooldown=3).orderBy("us").collect()
    assert [(r["final_signal"], r["trade_id"]) for r in out] == [(1, 1), (0, 1), (0, 0), (0, 0), (1, 2)]
    trade = backtest.trades(path(spark, [on, off, on, on, on], min_hold=1, cooldown=3)).first()
    assert (trade["entry_us"], trade["exit_us"], trade["pnl_pct"], trade["exit_reason"]) == (0, 1, 0.0, "signal")


def test_time_windows_leave_their_left_edge_out(spark):
    df = spark.createDataFrame([("x", t * 5_000_000) for t in range(3)], "symbol string, us long")
    counts = df.withColumn("n", series.over_time(F.count("us"), ["symbol"], "us", 5_000_000))
    assert [r["n"] for r in counts.collect()] == [1, 1, 1]


def test_nearest_prefers_the_earlier_and_the_tail_matches_the_last(spark):
    left = spark.createDataFrame([("x", t) for t in (10, 20, 99)], "s string, t long")
    right = spark.createDataFrame([("x", 5, 1, 0), ("x", 15, 2, 1), ("x", 15, 3, 2), ("x", 25, 4, 3)], "s string, t long, v int, tie long")
    got = asof.nearest(left, right, ["s"], "t", "v", "tie", "found").orderBy("t").collect()
    assert [r["found"] for r in got] == [1, 3, 4]
    early = spark.createDataFrame([("x", 1), ("y", 1)], "s string, t long")
    assert [r["found"] for r in asof.backward(early, right, ["s"], "t", "v", "tie", "found").collect()] == [None, None]


@pytest.mark.parametrize("chunk", [7, 50, 1000])
def test_halo_running_and_lag_match_plain_windows(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("ab"), rng.randrange(400), i, float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, us long, id long, v double")
    plain = df.withColumns({"s": series.over_time(F.sum("v"), ["k"], "us", 33), "c": F.sum("v").over(series.ordered(["k"], ["us", "id"]).rowsBetween(-(10**6), 0)), "l": F.lag("v").over(series.ordered(["k"], ["us", "id"]))})
    out = series.with_halo(df, "us", chunk, 33, lambda d, c: d.withColumn("s", series.over_time(F.sum("v"), ["k", c], "us", 33)))
    out = series.running(out, ["k"], ["us", "id"], "us", chunk, {"c": ("sum", "v")})
    out = series.lagged(out, ["k"], ["us", "id"], "us", chunk, "v", "l")
    columns = ["id", "s", "c", "l"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_features_do_not_depend_on_the_chunks(spark):
    rng = random.Random(1)
    t, rows = 0, []
    for i in range(500):
        t += rng.choice([0, 100_000, 3_000_000, 40_000_000])
        rows.append(("x", t, 10 + rng.random(), rng.random(), i, rng.random() < 0.5))
    df = spark.createDataFrame(rows, TICK)
    one, many = (features.tick_windows(df, 5, chunk_seconds=c).orderBy("us").collect() for c in (10**6, 60))
    assert len(one) == len(many)
    for a, b in zip(one, many, strict=True):
        assert a["us"] == b["us"] and all(a[c] == b[c] or a[c] == pytest.approx(b[c], abs=1e-9) for c in ("tfi", "obi", "arrival_rate", "volatility_cluster"))


def test_thresholds_without_trades_and_with_ties(spark):
    none = spark.createDataFrame([(0.5, 0.1)], "score double, return_pct double").where("score < 0")
    assert dict(map(tuple, learning.best_thresholds(learning.threshold_table(none)).collect())) == {"long": 0.55, "short": 0.45}
    tied = spark.createDataFrame([(0.9, 0.1), (0.9, -0.05)], "score double, return_pct double")
    assert dict(map(tuple, learning.best_thresholds(learning.threshold_table(tied)).collect()))["long"] == 0.51


def messages(spark, rows):
    side = "array<struct<price: double, size: double>>"
    return spark.createDataFrame([("x", i, i, kind, [(p, s) for p, s in b], [(p, s) for p, s in a]) for i, (kind, b, a) in enumerate(rows)], f"symbol string, seq long, us long, type string, bids {side}, asks {side}")


def test_books_delete_pad_and_start_anew(spark):
    rows = [("delta", [(9.0, 1.0)], []), ("snapshot", [(9.0, 1.0), (8.0, 0.0)], [(11.0, 2.0)]), ("delta", [(9.5, 4.0)], [(12.0, 0.0)]), ("delta", [(9.5, 0.0), (9.0, 3.0)], []), ("snapshot", [], [(20.0, 1.0)])]
    got = book.states(messages(spark, rows), 3).orderBy("seq").collect()
    assert [(r["best_bid"], r["best_ask"]) for r in got] == [(9.0, None), (9.0, 11.0), (9.5, 11.0), (9.0, 11.0), (None, 20.0)]
    assert [(r["bid_depth"], r["ask_depth"]) for r in got] == [(1.0, 0.0), (1.0, 2.0), (5.0, 2.0), (3.0, 2.0), (0.0, 1.0)]
    assert [tuple(x) for x in got[1]["bids"]] == [(9.0, 1.0), (8.0, 0.0), (pytest.approx(7.99), 0.0)]
    assert [x["price"] for x in got[4]["bids"]] == [pytest.approx(20 - 0.02), pytest.approx(20 - 0.03), pytest.approx(20 - 0.04)]
    running = {r["seq"]: (r["bid_depth"], r["ask_depth"]) for r in book.depths(messages(spark, rows)).collect()}
    assert all(running[r["seq"]] == (r["bid_depth"], r["ask_depth"]) for r in got)


def test_json_messages(spark, tmp_path):
    lines = [{"type": "snapshot", "ts": 5, "data": {"b": [["1.5", "2"]], "a": [["2.5", "0.0"]]}}, {"type": "other", "ts": 5, "data": {"b": [], "a": []}}, {"type": "delta", "ts": 0, "data": {"b": []}}, {"type": "delta", "ts": 7, "data": {}}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = book.from_json(sources.read_book_messages(spark, str(tmp_path)), "x", "ts").collect()
    assert [(r["type"], r["us"], [tuple(b) for b in r["bids"]], [tuple(a) for a in r["asks"]]) for r in got] == [("snapshot", 5000, [(1.5, 2.0)], [(2.5, 0.0)])]


def test_advantages(spark):
    steps = spark.createDataFrame([("e", i, 1.0, 0.0, i == 2) for i in range(3)], "e string, i long, reward double, value double, done boolean")
    got = paths.advantages(steps, ["e"], "i", 1.0, 1.0).orderBy("i").collect()
    assert [r["advantage"] for r in got] == [3.0, 2.0, 1.0]


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_advantages_do_not_depend_on_the_chunks(spark, chunk):
    rng = random.Random(4)
    rows = [(k, i, rng.gauss(0, 1), rng.gauss(0, 1), rng.random() < 0.05) for k in "ab" for i in range(200)]
    want = {}
    for k in "ab":
        ahead = later = 0.0
        for _, i, reward, value, done in reversed([r for r in rows if r[0] == k]):
            later = reward + 0.99 * (0 if done else ahead) - value + 0.99 * 0.95 * (0 if done else later)
            ahead = value
            want[k, i] = later
    steps = spark.createDataFrame(rows, "e string, i long, reward double, value double, done boolean")
    got = {(r["e"], r["i"]): r["advantage"] for r in paths.advantages(steps, ["e"], "i", chunk=chunk).collect()}
    assert got == pytest.approx(want)


def test_flat_and_lossless_paths(spark):
    steps = spark.createDataFrame([(e, i, p) for e, ps in ((1, [2, 2, 2]), (2, [1, 2, 3]), (3, [5])) for i, p in enumerate(map(float, ps))], "episode long, step long, pnl double")
    got = {r["episode"]: (r["sharpe"], r["sortino"]) for r in paths.path_figures(steps, ["episode"], "step", "pnl").collect()}
    assert got[1] == (0.0, 10.0) and got[2][1] == 10.0 and got[3] == (0.0, 0.0)


@pytest.mark.parametrize("chunk", [5, 60, 5000])
def test_trailing_spans_match_plain_windows(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("ab"), rng.randrange(400), rng.choice([None, 70_000 + rng.random() / 100])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, us long, v double")
    asked = {f"{kind}_{span}": (kind, "v", span) for kind in ("sum", "count", "min", "max", "stddev_samp", "stddev_pop") for span in (7, 33, 400)}
    plain = df.withColumns({n: series.over_time(getattr(F, kind)("v"), ["k"], "us", span) for n, (kind, _, span) in asked.items()})
    order = lambda d: sorted(([r["k"], r["us"], str(r["v"])], [r[n] for n in asked]) for r in d.select("k", "us", "v", *asked).collect())
    for (a, x), (b, y) in zip(order(series.trailing(df, ["k"], "us", chunk, asked)), order(plain), strict=True):
        assert a == b and all(p == q or p == pytest.approx(q, rel=1e-6, abs=1e-9) for p, q in zip(x, y, strict=True))


def test_long_series_take_linear_time(spark):
    """As-of labels and fills on one symbol: ten times the rows in far less than a hundred times the time."""
    took = []
    for n in (20_000, 200_000):
        bars = spark.range(n).select(F.lit("x").alias("symbol"), (F.col("id") * 60_000_000).alias("bucket"), (F.col("id") % 97 + 1.0).alias("close"))
        began = time.perf_counter()
        assert asof.labelled(bars, ["symbol"], "bucket", "close", 600_000_000).where("future_price is null").count() == 0
        w = series.ordered(["symbol"], ["bucket"])
        assert bars.withColumn("f", series.filled("close", w)).where("f is null").count() == 0
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_grid_features_by_hand(spark):
    """Ticks at 1, 2 and 31 s on a grid of 10 s: the grid is dense, and its windows reach back over empty steps."""
    ticks = spark.createDataFrame([("x", 1_000_000, 10.0, 3.0, 1, False), ("x", 2_000_000, 12.0, 1.0, 2, True), ("x", 31_000_000, 11.0, 2.0, 3, True)], TICK)
    got = features.grid_features(ticks, 10).orderBy("bucket").collect()
    assert [r["bucket"] // 1_000_000 for r in got] == [0, 10, 20, 30]
    assert [r["order_book_imbalance"] for r in got] == [0, 0.5, 0.5, 0.5] and [r["trade_flow_imbalance"] for r in got] == [0, 0.5, 0, 0]
    assert [r["spread_proxy"] for r in got] == [0, 2, 0, 0] and [r["trade_arrival_rate"] for r in got] == [0, 0.2, 0, 0]
    assert [r["tick_imbalance"] for r in got] == [0, 1, 1, 1]
    # deviations 0, 1, 1, 1 against their means 0, 1/2, 2/3, 3/4
    assert [r["volatility_cluster"] for r in got] == pytest.approx([1.0, 2.0, 1.5, 4 / 3])


def test_threshold_score_by_hand(spark):
    """Scores 0.6, 0.6, 0.4; a cost of 0.01: long gains 0.04 and -0.03 at every threshold."""
    df = spark.createDataFrame([(0.6, 0.05), (0.6, -0.02), (0.4, 0.1)], "score double, return_pct double")
    rows = {(r["side"], r["k"]): r for r in learning.threshold_table(df, cost=0.01).collect()}
    sd = 0.07 / 2**0.5
    long = rows["long", 0]
    assert (long["n"], long["win_rate"]) == (2, 0.5) and long["score"] == pytest.approx(0.4 * 0.005 + 0.4 * 0.005 / sd + 0.2 * 4 / 3)
    short = rows["short", 20]
    assert (short["n"], short["mean_return"], short["sharpe"], short["profit_factor"]) == (1, pytest.approx(-0.11), 0.0, 0.0)


def test_signal_figures_by_hand(spark):
    """One row with both signals, one long gain, no loss."""
    rows = [("x", 0, 0.5, 0.02, 1), ("x", 86_400_000_000, 0.9, 0.05, 1)]
    df = spark.createDataFrame(rows, "symbol string, us long, score double, return_pct double, label int")
    signalled = learning.with_signals(df, 0.5, 0.5)
    got = learning.backtest_metrics(learning.signal_backtest(signalled, ["symbol"], ["us"]), ["symbol"], "us", "label", "score").first()
    assert (got["total_trades"], got["win_rate"], got["profit_factor"]) == (3, pytest.approx(2 / 3), math.inf)
    assert (got["long_precision"], got["short_precision"], got["roc_auc"]) == (1.0, 0.0, None)
    assert got["final_pnl"] == pytest.approx(0.05) and got["annualised_return"] == pytest.approx(1.05**365 - 1)


def test_curve_areas_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (-3.0, 0)], "score double, label int")
    got = learning.auc(df, "label", "score").first()
    assert got["roc_auc"] == pytest.approx((1 + 1 + 1 + 0.5 + 1 + 0) / 6) and got["average_precision"] == pytest.approx((1 + 0.5) / 2)
    assert got["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * (0.5 + 0.5) / 2)


def test_statistics_of_small_deviations_at_a_high_level(spark):
    rng = random.Random(6)
    values = [70_000 + rng.gauss(0, 0.01) for _ in range(4000)]
    df = spark.createDataFrame([("k", i, v, 3 * (v - 70_000) + rng.gauss(0, 0.001)) for i, v in enumerate(values)], "k string, i long, v double, y double")
    of = lambda d: d.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    got = candles.merged_stats(of(df.where("i < 100")), of(df.where("i >= 100")), ["k"]).first()
    assert got["sd"] == pytest.approx(statistics.stdev(values), rel=1e-6) and got["mean"] == pytest.approx(statistics.mean(values), rel=1e-12)
    assert math.sqrt(research.least_squares(df, ["k"], "y", ["v"]).first()["rss"] / 3998) == pytest.approx(0.001, rel=0.1)


def test_model_bundle_search_and_reports(spark, tmp_path):
    rng = random.Random(3)
    rows = [(float(a := rng.random()), rng.random(), int(a > 0.5), a - 0.5) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label int, return_pct double")
    model = learning.boosted_trees(df, ["a", "b"], rounds=3)
    scored = learning.scored(model, df)
    thresholds = learning.best_thresholds(learning.threshold_table(scored))
    learning.save_bundle(model, spark, str(tmp_path / "bundle"), ["a", "b"], thresholds, candles.described(df, ["a", "b"]), learning.auc(scored, "label", "score"), {"step": 5})
    bundle = learning.load_bundle(spark, str(tmp_path / "bundle"))
    assert bundle["config"] == {"features": ["a", "b"], "step": 5} and set(bundle["thresholds"]) == {"long", "short"}
    assert bundle["importance"].first()["feature"] == "a"
    assert learning.scored(bundle["model"], df).agg(F.sum("score")).first()[0] == pytest.approx(scored.agg(F.sum("score")).first()[0])
    learning.write_reports(scored.withColumn("p", (F.col("score") > 0.5).cast("int")), str(tmp_path / "reports"), "label", "p", "score")
    assert float(spark.read.text(str(tmp_path / "reports/roc_auc")).first()[0]) > 0.95
    best, tried = learning.search(df, df, ["a", "b"], trials=2)
    assert len(tried) == 2 and max(tried, key=lambda t: t[1])[0] == best


def test_state_vectors_and_histories(spark):
    rows = [("snapshot", [(9.0, 1.0)], [(11.0, 2.0)]), ("trade", [(10.5, 1.0)], []), ("delta", [], [(11.0, 0.0)])]
    states = book.states(messages(spark, rows), 2).orderBy("seq")
    assert [r["mid"] for r in states.collect()] == [10.0, 10.0, 10.5]
    wide = book.state_vector(book.market_features(states), 64).orderBy("seq").first()["vector"]
    assert len(wide) == 64 and wide[:8] == [0.9, 1.0, pytest.approx(0.899), 0.0, 1.1, 2.0, pytest.approx(1.101), 0.0] and wide[8:13] == [2.0, 1.0, pytest.approx(29 / 3), 10.0, 0.0]
    got = book.history(states.withColumn("v", F.array("mid")), ["symbol"], ["seq"], "v", 3).orderBy("seq").collect()
    assert [[v[0] for v in r["history"]] for r in got] == [[10.0, 10.0, 10.0], [10.0, 10.0, 10.0], [10.0, 10.0, 10.5]]


def test_books_of_many_random_messages(spark):
    rng = random.Random(8)
    rows = [("snapshot" if k % 37 == 5 else "delta", [(float(rng.randrange(40)), float(rng.randrange(3)))] * (rng.random() < 0.7), [(float(50 + rng.randrange(40)), float(rng.randrange(3)))] * (rng.random() < 0.7)) for k in range(200)]
    sides, want = ({}, {}), []
    for kind, *both in rows:
        for side, levels in zip(sides, both, strict=True):
            if kind == "snapshot":
                side.clear()
            for p, s in levels:
                if kind == "delta" and not s:
                    side.pop(p, None)
                else:
                    side[p] = s
        want.append((sorted(sides[0].items(), reverse=True)[:3], sorted(sides[1].items())[:3]))
    got = book.states(messages(spark, rows), 3).orderBy("seq").collect()
    for r, (bids, asks) in zip(got, want, strict=True):
        assert [tuple(x) for x in r["bids"]][: len(bids)] == bids and [tuple(x) for x in r["asks"]][: len(asks)] == asks
        assert r["best_bid"] == (bids[0][0] if bids else None) and r["best_ask"] == (asks[0][0] if asks else None)


def test_merged_statistics_are_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,), (7.0,)], "v double").selectExpr("'k' as k", "v")
    of = lambda d: d.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    got = candles.merged_stats(of(df.where("v < 3")), of(df.where("v > 3")), ["k"]).first()
    want = of(df).first()
    assert got["n"] == want["n"] and got["mean"] == want["mean"] and got["sd"] == pytest.approx(want["sd"])


def test_granger_finds_the_cause(spark):
    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(300)]
    y = [0.0] + [0.8 * x[i - 1] + rng.gauss(0, 0.3) for i in range(1, 300)]
    df = spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k string, i long, x double, y double")
    assert research.granger(df, ["k"], ["i"], "y", "x", 1).first()["f"] > 100
    assert research.granger(df, ["k"], ["i"], "x", "y", 1).first()["f"] < 10


def test_sources(spark, tmp_path):
    (tmp_path / "agg.csv").write_text("aggTradeId,price,qty,firstTradeId,lastTradeId,timestamp,maker\n1,10.5,2,1,1,1500,True\n2,11,1,2,2,1600,False\nbad,line\n")
    got = sources.read_aggregated_trades(spark, str(tmp_path / "agg.csv")).orderBy("trade_id").collect()
    assert [(r["price"], r["is_buyer_maker"]) for r in got if r["price"]] == [(10.5, True), (11.0, False)]
    (tmp_path / "spot.csv").write_text("1,1.5,2,3,1700000000000000,True,True\n2,1.5,2,3,nonsense,1,True\n3,1,1,1,1700003600000000,0,True\n")
    trades = sources.load_trades(spark, str(tmp_path / "spot.csv"))
    assert sorted((r["trade_id"], r["is_buyer_maker"], r["hour"]) for r in trades.collect()) == [(1, True, "20231114_22"), (3, False, "20231114_23")]
    assert sources.read_hour(spark, str(tmp_path / "spot.csv_parquet"), "20231114_23", ["trade_id"]).first()[0] == 3
    assert sources.load_trades(spark, str(tmp_path / "spot.csv")).count() == 2
    assert sorted((r["hour"], r["n_rows"]) for r in spark.read.json(str(tmp_path / "spot.csv_parquet_manifest")).collect()) == [("20231114_22", 1), ("20231114_23", 1)]
    shutil.rmtree(next((tmp_path / "spot.csv_parquet").glob("hour=20231114_22")))  # an hour is lost: the table is set aside and written again
    assert sources.load_trades(spark, str(tmp_path / "spot.csv")).count() == 2 and (tmp_path / "spot.csv_parquet_backup_1").exists()
    trades = spark.read.parquet(str(tmp_path / "spot.csv_parquet"))
    sources.write_months(trades.select("datetime", "price"), str(tmp_path / "months"), "datetime")
    assert spark.read.json(str(tmp_path / "months_metadata")).first()["n_rows"] == 2 and spark.read.json(str(tmp_path / "months_described")).first()["name"] == "price"
    assert sources.first_lines(spark, str(tmp_path / "spot.csv"), 40).count() == 1
    grid = sources.time_grid(trades, "datetime", 1800).orderBy("grid_idx").collect()
    assert len(grid) == 3 and grid[0]["hour"] == "20231114_22"
    ticks = sources.random_ticks(spark, 50)
    assert ticks.count() == 50 and ticks.where("price <= 0 or quantity <= 0").count() == 0
    named = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 9.0)], "open double, high double, low double, `Adj Close` double, volume double")
    assert sources.price_columns(named).columns == ["Open", "High", "Low", "Close", "Volume"]
    with pytest.raises(ValueError, match="Close"):
        sources.price_columns(named.drop("Adj Close"))
    levels = named.toDF("Open_SPY", "('High', 'SPY')", "LOW", "Close_SPY", "volume")
    assert sources.price_columns(levels).columns == ["Open", "High", "Low", "Close", "Volume"] == sources.price_columns(named.toDF(*"abcde")).columns
    named.write.parquet(str(tmp_path / "few.parquet"))
    with pytest.raises(ValueError, match="fewer than 100"):
        sources.load_bars(spark, str(tmp_path / "few.parquet"))
    started = sources.from_random_start(spark.range(1000, 2000), "id", 3).agg(F.min("id")).first()[0]
    assert 1000 <= started < 1800
    shown = candles.timed(candles.candles(ticks.withColumn("us", F.unix_micros("ts")), 13))
    sources.write_candles(shown, str(tmp_path / "candles"), "Asia/Kolkata")
    assert spark.read.option("header", True).csv(str(tmp_path / "candles")).where("open_time like '2024-06-05 10:0%'").count() > 0


def test_boosted_trees_rank_a_simple_rule(spark):
    rng = random.Random(3)
    rows = [(float(a := rng.random()), rng.random(), int(a > 0.5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model, chosen = learning.top_features_model(df, ["a", "b"], keep=1, rounds=3)
    assert chosen == ["a"]
    assert learning.auc(learning.scored(model, df), "label", "score").first()["roc_auc"] > 0.95
