"""What the queries over the book and the ticks must keep to as the tables grow."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators import book, crossing
from tidemark.plans import market
from tidemark.streaming import rules as stream_rules
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_flow_reads_no_windows_of_rows(spark):
    """Frames of as many rows as the lookbacks have tenths of a second cost each message up to 216,000 rows."""
    text = plan(market.QUERIES["order_flow"](spark, SF))
    assert "stddev" not in text and "lag(" not in text


def test_order_flow_by_hand(spark):
    ticks = spark.createDataFrame([("a", 0, 1.0, False), ("a", 100_000, 3.0, True), ("a", 250_000, 2.0, False)], "symbol string, us long, quantity double, is_buyer_maker boolean")
    rows = spark.createDataFrame([("a", 1, 200_000), ("a", 2, 250_000), ("a", 3, 900_000), ("b", 4, 0)], "symbol string, seq long, us long")
    got = {r["seq"]: (r["ofi_1"], r["ofi_2"]) for r in book.order_flow(rows, ticks, (1, 2)).collect()}
    assert got == {1: (-1.0, -0.5), 2: (1.0, -0.2), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_volatility_after_a_mid_of_zero(spark):
    """The log return from or to a price of zero is infinite, so the deviations over it are no numbers; before, it was left out of them."""
    mids = [4.0] * 12 + [0.0] + [2.0] * 12
    rows = spark.createDataFrame([("a", k, k, m, 0.0, 0.0) for k, m in enumerate(mids)], "symbol string, seq long, us long, mid double, imbalance double, spread double")
    got = [r["vol_3"] for r in book.market_features(rows, (3,)).orderBy("seq").collect()]
    assert all(math.isnan(v) for v in got[12:15]) and got[:12] == [0.0] * 12 and got[15:] == [0.0] * 10


def test_a_table_streams_in_order_by_parts(spark, tmp_path):
    """Micro-batches of a bounded number of rows, in order, however the table is dealt; before, a table was one micro-batch."""
    stream = streams.in_order(spark.range(1000, numPartitions=3).repartition(5), "id", str(tmp_path / "in"), 250)
    seen = []
    stream.writeStream.foreachBatch(lambda df, n: seen.append((df.agg({"id": "min"}).first()[0], df.count()))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and [a for a, _ in seen] == sorted(a for a, _ in seen) and sum(n for _, n in seen) == 1000 and max(n for _, n in seen) < 400


class _Map(dict):
    """A map state that counts what it is asked."""

    calls = 0

    def iterator(self):
        return iter(self.items())

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


def test_books_tell_and_write_in_bounded_parts():
    """Books come in frames of at most OUT_ROWS rows and each changed level is written once; before, a symbol's micro-batch was one frame and every change one call."""
    state, kept = streams._Books(), {}
    state.maps, state.trade = [_Map({(3.0,): (1.0,)}), _Map()], type("", (), {"exists": lambda s: "t" in kept, "update": lambda s, v: kept.update(t=v)})()
    n = streams.OUT_ROWS + 5
    level = lambda k: [{"price": float(k % 2), "size": float(k)}]
    frames = [pd.DataFrame({"seq": [k], "us": [k], "type": ["snapshot" if k == 1 else "delta"], "bids": [level(k)], "asks": [[]]}) for k in range(n, 0, -1)]
    out = list(state.handleInputRows(("a",), iter(frames), None))
    assert [len(f) for f in out] == [streams.OUT_ROWS, 5] and out[0]["seq"].tolist() == list(range(1, streams.OUT_ROWS + 1))
    assert state.maps[0] == {(1.0,): (float(n),), (0.0,): (float(n - 1),)} and state.maps[0].calls == 3 and state.maps[1].calls == 0
    assert out[1]["bid_depth"].tolist()[-1] == n + n - 1 and not kept


def test_spans_across_many_chunks(spark):
    """Spans longer than a chunk take whole chunks from a row a chunk; before, every row was copied into each chunk that its span reaches."""
    ticks = spark.range(600).selectExpr("if(id % 3 = 0, 'a', 'b') as symbol", "id * id % 1009 as us", "if(id % 7 = 0, null, cast(hash(id) % 50 as double)) as v")
    kinds = ("sum", "count", "min", "max", "stddev_samp", "stddev_pop")
    asked = {f"{kind}_{span}": (kind, "v", span) for kind in kinds for span in (7, 40, 95, 400)}
    far, near = series.trailing(ticks, ["symbol"], "us", 20, asked), series.trailing(ticks, ["symbol"], "us", 5000, asked)
    order = ["symbol", "us", "v"]
    for a, b in zip(far.orderBy(*order).collect(), near.orderBy(*order).collect(), strict=True):
        assert a.asDict().keys() == b.asDict().keys()
        assert all(x == y or x is not None and y is not None and isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)
    assert "sequence" not in plan(series.trailing(ticks, ["symbol"], "us", 20, {"s": ("sum", "v", 400)}))


def test_chunks_are_as_short_as_rows_are_dense(spark):
    dense = spark.range(4096).selectExpr("'a' as symbol", "id * 16 as us").unionByName(spark.range(10).selectExpr("'b' as symbol", "id * 16 as us"))
    chunk, tasks = series.chunk_for(dense, ["symbol"], "us", 1 << 20, 128)
    assert chunk == 2048 and tasks == 33 and dense.groupBy("symbol", (F.col("us") / chunk).cast("long")).count().agg(F.max("count")).first()[0] == 128
    assert series.chunk_for(dense, ["symbol"], "us", 1 << 20) == (1 << 20, 4) and series.chunk_for(dense.limit(0), ["symbol"], "us", 1000) == (1000, 4)


def book_rows(spark, seed, odd):
    """Messages of two symbols: snapshots, deltas and trades of one to three levels, with sizes of zero and, if asked, missing and undefined numbers."""
    pick = random.Random(seed)
    size = lambda symbol: pick.choice([0.0, 1.0, 2.5, 4.0, *([None, math.nan] if odd and symbol == "b" else [])])
    side = lambda symbol, least: [(float(pick.randrange(least, least + 6)), size(symbol)) for _ in range(pick.randrange(4))]
    rows = [(symbol, seq, seq * 10, "snapshot" if seq % 17 == 5 else "trade" if seq % 5 == 0 else "delta", side(symbol, 90), side(symbol, 94)) for symbol in "ab" for seq in range(120)]
    return spark.createDataFrame(rows, f"symbol string, seq long, us long, type string, bids {book._SIDE}, asks {book._SIDE}")


@pytest.mark.parametrize("odd", [False, True])
def test_replayed_epochs_are_as_those_of_blocks(spark, monkeypatch, odd):
    """Short epochs are replayed, without a row a message and power of two; before, all were."""
    messages = book_rows(spark, 3, odd)
    ran = []
    real = book._replayed
    monkeypatch.setattr(book, "_replayed", lambda rows, levels: ran.append(rows.count()) or real(rows, levels))
    short = book.states(messages, 3).orderBy("symbol", "seq").collect()
    monkeypatch.setattr(book, "REPLAYED", 0)
    assert str(short) == str(book.states(messages, 3).orderBy("symbol", "seq").collect())
    assert ran[1] == 0 and (0 < ran[0] < 240 if odd else ran[0] == 240)


def test_epochs_are_replayed_whole_whatever_the_join_becomes(spark, tmp_path):
    """A join that turns out small enough to be broadcast leaves rows where they lie; before, an epoch's messages of several files were then replayed apart."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        level = f"cast(array(named_struct('price', cast(id % 8 as double), 'size', 1.0D)) as {book._SIDE})"
        rows = spark.range(320).selectExpr("'a' as symbol", "id div 8 as epoch", "id as seq", "id as us", "'delta' as type", f"{level} as bids", f"cast(array() as {book._SIDE}) as asks")
        rows.repartition(4, "seq").write.parquet(str(tmp_path / "m"))
        rows = spark.read.parquet(str(tmp_path / "m"))
        rows = rows.join(rows.groupBy("symbol", "epoch").agg(F.count("*").alias("n")), ["symbol", "epoch"])
        assert {r["seq"]: r["bid_depth"] for r in book._replayed(rows, 1).collect()} == {k: k % 8 + 1 for k in range(320)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_near_crossings_climb_no_further(spark):
    """Limits that are crossed in the lowest block are asked for there alone; before, each asked at every height."""
    values = spark.range(300).selectExpr("'a' as symbol", "id as k", "cast(if(id = 299, -5, id % 4) as double) as v")
    limits = spark.createDataFrame([("a", k, k, 0.0 if k % 3 else -1.0) for k in range(300)], "symbol string, id long, since long, l double")
    got = {r["id"]: r["hit"] for r in crossing.first_at_most(limits, values, ["symbol"], ["id"], "since", "k", {"v": "l"}, "hit", fan=4).collect()}
    value = lambda k: -5 if k == 299 else k % 4
    assert got == {k: next((j for j in range(k, 300) if value(j) <= (0 if k % 3 else -1)), None) for k in range(300)}
    assert any("crossing-near" in f for f in crossing.first_at_most(limits, values, ["symbol"], ["id"], "since", "k", {"v": "l"}, "hit", fan=4).inputFiles())


class _List:
    """A list state, and the calls it gets."""

    def __init__(self):
        self.held, self.calls = [], 0

    def appendValue(self, value):  # noqa: N802
        self.calls += 1
        self.held.append(value)

    def appendList(self, values):  # noqa: N802
        self.calls += len(values)
        self.held += values

    def get(self):
        return iter(self.held)


def test_waiting_rows_are_state_by_frames(spark):
    """A frame of rows is one element of the state, and one timer waits for all of a micro-batch; before, each row was an element and each frame had a timer."""
    alarms, timers = stream_rules._Alarms(2, 100), []
    alarms.waiting, alarms.handle = _List(), type("", (), {"registerTimer": lambda s, ms: timers.append(ms)})()
    frames = [pd.DataFrame({"us": range(k, k + 500), "tie": 1, "level": 0}) for k in (9_000, 4_000, 6_000)]
    list(alarms.handleInputRows(("a",), iter(frames), type("", (), {"getCurrentWatermarkInMs": lambda s: 1})()))
    assert alarms.waiting.calls == 3 and timers == [4]
