import math

import pytest

from tidemark.operators import learning
from tidemark.streaming import online, streams

ROWS = "k string, us long, id long, value double"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def test_versions_compaction_retries_and_late_rows(spark, tmp_path):
    table = online.OnlineTable(str(tmp_path / "t"), ["k"], ["us", "id"], every=2)
    assert table.version(spark) is None
    with pytest.raises(ValueError):
        table.read(spark)
    batches = [batch(spark, ("a", 1, 1, 1.0), ("b", 5, 2, 2.0), ("a", 1, 3, 3.0)), batch(spark, ("a", 9, 4, None)), batch(spark, ("b", 4, 5, 9.0), (None, 1, 6, 6.0)), batch(spark), batch(spark, ("b", 7, 7, 7.0))]
    found = []
    for n, rows in enumerate(batches):
        table(rows, n)
        table(rows, n)  # the batch again, as after a crash before its log
        found.append(sorted((tuple(r) for r in table.read(spark).collect()), key=str))
    assert found[0] == [("a", 1, 3, 3.0), ("b", 5, 2, 2.0)]
    assert found[1] == [("a", 9, 4, None), ("b", 5, 2, 2.0)]
    assert found[2] == found[3] == [("a", 9, 4, None), ("b", 5, 2, 2.0), (None, 1, 6, 6.0)]
    assert found[4] == [("a", 9, 4, None), ("b", 7, 7, 7.0), (None, 1, 6, 6.0)]
    again = online.OnlineTable(str(tmp_path / "t"), ["k"], ["us", "id"], every=2)  # a reader elsewhere, on an older version
    assert sorted((tuple(r) for r in again.read(spark, 1).collect()), key=str) == found[1] and again.version(spark) == 4
    read = again.read(spark).inputFiles()
    assert any("bases/v3" in f for f in read) and not any("batch=3" in f or "batch=0" in f for f in read)


def test_scale_by_what_was_seen_and_once_after_a_retry(spark, tmp_path):
    scale = streams.RunningScale(str(tmp_path / "s"), ["value"])
    first, second = batch(spark, ("a", 1, 1, 1.0), ("a", 2, 2, 3.0)), batch(spark, ("a", 3, 3, 5.0), ("a", 4, 4, None))
    assert [r["value"] for r in scale(first, 0).orderBy("id").collect()] == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)])
    once = [tuple(r) for r in scale(second, 1).orderBy("id").collect()]
    assert once == [("a", 3, 3, 1.0, 1), ("a", 4, 4, None, 1)]
    assert [tuple(r) for r in scale(second, 1).orderBy("id").collect()] == once
    assert scale.statistics(spark, 1).select("n", "mean", "sd").first() == (3, 3.0, 2.0)
    flat = streams.RunningScale(str(tmp_path / "f"), ["value"])
    assert [r["value"] for r in flat(batch(spark, ("a", 1, 1, 4.0), ("a", 2, 2, 4.0)), 0).collect()] == [0.0, 0.0]


def test_normalised_training_and_equal_scores_after_a_restart(spark, tmp_path):
    batches = [batch(spark, *((str(i), i, i, 100.0 + i % 7) for i in range(k * 40, k * 40 + 40))) for k in range(4)]
    fits = []

    def fit(df):
        fits.append(df.count())
        return learning.boosted_trees(df.withColumn("label", (df["value"] > 0).cast("int")), ["value"], rounds=2)

    def step():
        return streams.NormaliseTrainThenScore(["value"], fit, lambda m, df: learning.scored(m, df), str(tmp_path / "store"), str(tmp_path / "out"), 60)

    whole = step()
    for n, rows in enumerate(batches):
        whole(rows, n)
    scores = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "value", "stats_version", "model_version", "score").collect())
    before = scores()
    step()(batches[3], 3)  # another driver takes the last batch again
    assert scores() == before and fits == [80] and len(before) == 120
    assert {(v, m) for _, _, v, m, _ in before} == {(1, 1), (2, 1), (3, 1)}
