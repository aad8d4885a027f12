import datetime as dt
import random

import pytest

from tidemark.operators import rules as stored_rules
from tidemark.streaming import rules, streams

SECOND = 1_000_000
ROWS = "symbol string, us long, tie long, value double"
TICKS = "symbol string, ts timestamp, tie long, value double"


def at(second):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=second)


def plain(rows, limits, in_row, quiet, until=None):
    """The rule read row by row."""
    out, keys = [], sorted({r[0] for r in rows})
    for key in keys:
        last = run = tier = 0
        alive = raised = False
        for _, us, _, value in sorted((r for r in rows if r[0] == key and (until is None or r[1] <= until)), key=lambda r: r[1:3]):
            if alive and us - last >= quiet:
                if raised:
                    out.append((key, last + quiet, "release", tier))
                alive = raised = False
                run = tier = 0
            n = sum(value is not None and value > x for x in limits)
            if not n:
                run = 0
                continue
            alive, last, run = True, us, run + 1
            if raised and n > tier:
                out.append((key, us, "escalate", n))
            tier = max(tier, n)
            if not raised and run >= in_row:
                raised = True
                out.append((key, us, "raise", tier))
        if raised and (until is None or last + quiet <= until):
            out.append((key, last + quiet, "release", tier))
    return sorted(out)


def made(n, seed=5):
    draw = random.Random(seed)
    value = lambda: None if draw.random() < 0.05 else draw.choice([0.0, 0.0, 1.5, 1.5, 2.5, 3.5])
    return [(draw.choice(["hot", "hot", "hot", "cold"]), draw.randint(1, n) * SECOND, k, value()) for k in range(n)]


@pytest.mark.parametrize("in_row,quiet", [(1, 2), (3, 4), (2, 10)])
def test_actions_of_stored_rows(spark, in_row, quiet):
    rows = made(800)
    got = stored_rules.actions(spark.createDataFrame(rows, ROWS), ["symbol"], "us", "tie", "value", [1.0, 2.0, 3.0], in_row, quiet * SECOND, chunk=50 * SECOND)
    assert got.columns == ["symbol", "us", "action", "tier"]
    expected = plain(rows, [1.0, 2.0, 3.0], in_row, quiet * SECOND)
    assert {a for _, _, a, _ in expected} == {"raise", "escalate", "release"}
    assert sorted(map(tuple, got.collect())) == expected


def test_no_rows_and_wrong_limits(spark):
    empty = spark.createDataFrame([], ROWS)
    assert stored_rules.actions(empty, ["symbol"], "us", "tie", "value", [1.0], 2, SECOND).collect() == []
    with pytest.raises(ValueError):
        stored_rules.actions(empty, ["symbol"], "us", "tie", "value", [2.0, 1.0], 2, SECOND)


def test_a_growing_key_fills_several_tasks(spark):
    rows = spark.range(100_000).selectExpr("'x' as symbol", "id * 1000000 as us", "id as tie", "case when id % 7 < 4 then 2.0 else 0.0 end as value")
    got = stored_rules.actions(rows, ["symbol"], "us", "tie", "value", [1.0], 4, 2 * SECOND, chunk=1000 * SECOND)
    # rows 0 to 3 of each seven breach; rows 4 to 6 end the alarm two seconds after the fourth
    assert {(r["action"], r["count"]) for r in got.groupBy("action").count().collect()} == {("raise", 14285 + 1), ("release", 14285 + 1)}


def test_a_stream_out_of_order_with_a_restart_and_late_rows(spark, tmp_path):
    before = spark.conf.get(streams.ROCKS[0])
    spark.conf.set(*streams.ROCKS)
    try:
        rows = [(s, us // SECOND, k, v) for s, us, k, v in sorted(made(300), key=lambda r: r[1])]
        draw = random.Random(1)
        batches = [[(s, at(t), k, v) for s, t, k, v in draw.sample(part, len(part))] for part in (rows[:80], rows[80:200], rows[200:])]
        late = [("hot", at(1), 9001, 3.5)]
        # two neighbours change places, within the lateness
        batches[0][0], batches[1][0] = batches[1][0], batches[0][0]
        out = str(tmp_path / "out")

        def run(k, rows):
            spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            found = rules.actions(stream, "value", [1.0, 2.0, 3.0], 2, 4 * SECOND, "200 seconds")
            found.writeStream.foreachBatch(streams.versions(out)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

        # each run starts the stream again from its log
        for k, files in enumerate([*batches[:2], [*batches[2], ("cold", at(2000), 9000, 0.0)], late]):
            run(k, files)
        base = int(at(0).timestamp()) * SECOND
        everything = [(s, int(t.timestamp()) * SECOND, k, v) for b in batches for s, t, k, v in b]
        got = sorted((r["symbol"], r["us"], r["action"], r["tier"]) for r in spark.read.parquet(out).collect())
        assert got == plain(everything, [1.0, 2.0, 3.0], 2, 4 * SECOND, base + 1800 * SECOND)
    finally:
        spark.conf.set(streams.ROCKS[0], before)
