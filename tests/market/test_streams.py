import datetime as dt

import pytest

from tidemark.streaming import streams

TICKS = "symbol string, ts timestamp, price double, quantity double, trade_id long"


def at(second):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=second)


def feed(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(folder)


def run(stream, name, tmp_path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"log-{name}")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_late_ticks_merge_within_the_watermark_and_drop_beyond_it(spark, tmp_path):
    batches = [[("x", at(1), 5.0, 1.0, 1), ("x", at(12), 6.0, 1.0, 2)], [("x", at(3), 9.0, 1.0, 3), ("x", at(40), 1.0, 1.0, 4)], [("x", at(41), 1.0, 1.0, 7)], [("x", at(4), 99.0, 1.0, 5), ("x", at(80), 1.0, 1.0, 6)]]
    got = run(streams.candles(feed(spark, str(tmp_path / "in"), batches, TICKS), 10, "15 seconds"), "late", tmp_path)
    first = min(got, key=lambda r: r["bucket"])
    assert (first["open"], first["high"], first["close"], first["tick_count"]) == (5.0, 9.0, 9.0, 2)


def test_sessions_and_alerts(spark, tmp_path):
    batches = [[("x", at(1), 5.0, 1.0, 1), ("x", at(3), 9.0, 1.0, 2)], [("x", at(30), 5.0, 1.0, 3)], [("x", at(100), 5.0, 1.0, 4)]]
    got = run(streams.sessions(feed(spark, str(tmp_path / "in"), batches, TICKS), "10 seconds", "1 second"), "sessions", tmp_path)
    assert sorted(r["n"] for r in got) == [1, 2]
    got = run(streams.alerts(feed(spark, str(tmp_path / "in2"), batches, TICKS), 10, "1 second", 0.5, 100), "alerts", tmp_path)
    assert [r["reason"] for r in got] == ["range"]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(streams.ROCKS[0])
    spark.conf.set(*streams.ROCKS)
    yield
    spark.conf.set(streams.ROCKS[0], before)


def test_a_bounded_list_of_recent_values(spark, tmp_path, rocks):
    batches = [[("x", 1, 1.0), ("x", 2, 3.0)], [("x", 3, 5.0)], [("x", 4, 1.0), ("y", 5, 2.0)]]
    got = run(streams.recent(feed(spark, str(tmp_path / "in"), batches, "symbol string, seq long, value double"), "value", 2), "recent", tmp_path)
    assert sorted((r["seq"], r["n"], r["mean"]) for r in got) == [(1, 1, 1.0), (2, 2, 2.0), (3, 2, 4.0), (4, 2, 3.0), (5, 1, 2.0)]


def test_one_model_across_restarts(spark, tmp_path):
    from tidemark.operators import learning

    rows = [[("x", at(i), float(i % 7), float(i), i) for i in range(k * 40, k * 40 + 40)] for k in range(4)]
    stream = feed(spark, str(tmp_path / "in"), rows, TICKS)
    fits = []

    def fit(df):
        fits.append(df.count())
        return learning.boosted_trees(df.withColumn("label", (df["price"] > 3).cast("int")), ["price"], rounds=2)

    for _ in range(2):  # the second run starts anew over the same batches with another object
        step = streams.TrainThenScore(fit, lambda m, df: learning.scored(m, df), str(tmp_path / "store"), str(tmp_path / "out"), 60)
        stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / f"log{len(fits)}")).trigger(availableNow=True).start().awaitTermination()
    assert fits == [80] and spark.read.parquet(str(tmp_path / "out")).count() == 160
    rest = streams.TrainThenScore(fit, lambda m, df: learning.scored(m, df), str(tmp_path / "store2"), str(tmp_path / "out2"), 1000)
    stream.writeStream.foreachBatch(rest).option("checkpointLocation", str(tmp_path / "log-rest")).trigger(availableNow=True).start().awaitTermination()
    rest.finish(spark)
    assert fits == [80, 160] and spark.read.parquet(str(tmp_path / "out2")).count() == 160


def test_books_keep_their_state_between_batches(spark, tmp_path, rocks):
    side = "array<struct<price: double, size: double>>"
    schema = f"symbol string, seq long, us long, type string, bids {side}, asks {side}"
    batches = [[("x", 1, 1, "snapshot", [(9.0, 1.0)], [(11.0, 1.0)])], [("x", 2, 2, "delta", [(10.0, 1.0)], [])], [("x", 3, 3, "delta", [(10.0, 0.0)], [(10.5, 2.0)])]]
    got = run(streams.books(feed(spark, str(tmp_path / "in"), batches, schema)), "books", tmp_path)
    assert [(r["best_bid"], r["best_ask"], r["ask_depth"]) for r in sorted(got, key=lambda r: r["seq"])] == [(9.0, 11.0, 1.0), (10.0, 11.0, 1.0), (9.0, 10.5, 3.0)]


def test_statistics_by_batch(spark, tmp_path):
    batches = [[("x", at(i), float(i), 1.0, i)] for i in range(4)]
    stream = feed(spark, str(tmp_path / "in"), batches, TICKS)
    stream.writeStream.foreachBatch(streams.stats_by_batch(str(tmp_path / "stats"), ["symbol"], "price")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(str(tmp_path / "stats/v3")).first()
    assert (last["n"], last["mean"]) == (4, 1.5) and abs(last["sd"] - 1.2909944) < 1e-6
