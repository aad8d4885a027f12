import pytest

from tidemark.sources import market

FIRST = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC
HOUR = 3_600_000_000


def line(k, us):
    return f"{k},{100 + k}.5,2.0,{200 + k}.0,{us},True,True\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv").mkdir()
    for n in range(3):
        (tmp_path / f"csv/{n}.csv").write_text("".join(line(n * 100 + k, FIRST + (n * 100 + k) * 60_000_000) for k in range(100)))
    return tmp_path


def test_a_stopped_conversion_goes_on(spark, folder, monkeypatch):
    csv, target, finish = str(folder / "csv"), str(folder / "out"), market._finish
    seen = []

    def stop(*args):
        seen.append(args)
        if len(seen) == 2:
            raise RuntimeError("stopped before the second record")
        finish(*args)

    monkeypatch.setattr(market, "_finish", stop)
    with pytest.raises(RuntimeError):
        market.convert_in_chunks(spark, csv, target, 1)
    assert market.read_converted(spark, target).count() == 100
    monkeypatch.setattr(market, "_finish", finish)
    first = sorted((f.name, f.stat().st_mtime_ns) for f in (folder / f"out/chunk={seen[0][2]}").rglob("*.parquet"))
    got = market.convert_in_chunks(spark, csv, target, 1)
    assert sorted(r["trade_id"] for r in got.collect()) == list(range(300))
    assert first == sorted((f.name, f.stat().st_mtime_ns) for f in (folder / f"out/chunk={seen[0][2]}").rglob("*.parquet"))
    # the manifest has every hour once, over all chunks that count
    told = {r["hour"]: (r["first_time"], r["last_time"], r["n_rows"]) for r in market.converted_ranges(spark, target).collect()}
    assert told == {f"20240101_{h:02d}": (FIRST + h * HOUR, FIRST + h * HOUR + 59 * 60_000_000, 60) for h in range(5)}
    (folder / "csv/3.csv").write_text(line(300, FIRST))
    assert market.convert_in_chunks(spark, csv, target).count() == 301
    (folder / "csv/0.csv").write_text(line(300, FIRST))
    with pytest.raises(ValueError, match="changed"):
        market.convert_in_chunks(spark, csv, target)


def test_ranges_come_from_footers(spark, folder):
    trades = market.read_spot_trades(spark, str(folder / "csv"))
    path = str(folder / "hours")
    market.write_hours(trades, path, 7)
    keep = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = {str(r["hour"]): (r["first_time"], r["last_time"], r["n_rows"]) for r in market.footer_ranges(spark, path).collect()}
    expected = {r["hour"]: tuple(r)[1:] for r in trades.groupBy("hour").agg({"timestamp": "min"}).collect()}
    assert {h: v[0] for h, v in got.items()} == {h: v[0] for h, v in expected.items()} and sum(v[2] for v in got.values()) == 300
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == keep
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        plan = market.footer_plan(spark, path, "timestamp")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", keep)
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
    assert "PushedAggregation: [MIN(timestamp), MAX(timestamp), COUNT(*)]" in plan


def test_the_manifest_chooses_the_hours(spark, folder):
    path = str(folder / "hours")
    market.write_hours(market.read_spot_trades(spark, str(folder / "csv")), path)
    got = market.read_between(spark, path, "2024-01-01 01:30:00", "2024-01-01 02:10:00")
    assert sorted(r["trade_id"] for r in got.collect()) == list(range(90, 131))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
