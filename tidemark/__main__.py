"""Command line: ``python -m tidemark <command> ...``; master and memory are spark-submit's or the environment's to set."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, backtest, features, indicators, learning
from tidemark.operators import candles as candle_ops
from tidemark.sources import market


def _ticks(trades: DataFrame, symbol: str) -> DataFrame:
    """Spot trades as ticks."""
    return trades.select(F.lit(symbol).alias("symbol"), F.unix_micros("datetime").alias("us"), F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"), "trade_id", "is_buyer_maker")


def candles(spark: SparkSession, a: argparse.Namespace) -> None:
    """Aggregated trades to candles, and their totals."""
    trades = market.read_aggregated_trades(spark, a.input, a.symbol).withColumn("us", F.unix_micros("ts"))
    found = candle_ops.candles(trades, a.seconds)
    market.write_candles(candle_ops.timed(found), a.output, a.zone)
    candle_ops.totals(found).show(truncate=False)


def matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    """Spot trades to the feature matrix by month."""
    made = features.feature_matrix(_ticks(market.load_trades(spark, a.input), a.symbol), a.seconds)
    market.write_months(made.withColumn("timestamp", F.timestamp_micros("bucket")), a.output)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """A feature matrix to a model, its thresholds, predictions and figures; the last fifth of the rows is never trained on."""
    rows = market.require(market.read_features(spark, a.input), ["symbol", "bucket", "mid_price"]).drop("month")
    labelled = asof.labelled(rows, ["symbol"], "bucket", "mid_price", a.horizon * 1_000_000)
    names = [c for c in rows.columns if c.startswith("feature_")]
    parts = features.split_by_time(labelled, ["symbol"], ["bucket"], {"train": 0.6, "valid": 0.2, "test": 0.2})
    train, valid, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "valid", "test"))
    model = learning.boosted_trees(train, names, rounds=a.rounds)
    chosen = learning.best_thresholds(learning.threshold_table(learning.scored(model, valid), cost=a.cost))
    limits = {r["side"]: r["threshold"] for r in chosen.collect()}
    signals = learning.with_signals(learning.scored(model, test), limits["long"], limits["short"])
    tested = learning.signal_backtest(signals, ["symbol"], ["bucket"], a.cost)
    figures = learning.backtest_metrics(tested, ["symbol"], "bucket", "label", "score")
    learning.save_bundle(model, spark, f"{a.output}/bundle", names, chosen, candle_ops.described(train, names), figures, {"horizon": a.horizon, "cost": a.cost})
    market.write_predictions(tested, figures, a.output)
    learning.write_reports(signals.withColumn("predicted", (F.col("score") > 0.5).cast("int")), f"{a.output}/reports", "label", "predicted", "score")


def simulate_trades(spark: SparkSession, a: argparse.Namespace) -> None:
    """Bars with usual price columns and a time to trades and performance."""
    raw = market.load_bars(spark, a.input)
    bars = raw.select(F.lit(a.symbol).alias("symbol"), F.unix_micros(F.col(a.time).cast("timestamp")).alias("us"), *(F.col(c).cast("double").alias(c.lower()) for c in market.PRICE_NAMES))
    s = indicators.Settings()
    rows = backtest.positions(indicators.signals(indicators.indicators(bars, s), s), s)
    rows = backtest.returns(backtest.costed(backtest.sized(rows, s), s))
    closed = backtest.trades(rows)
    closed.write.mode("overwrite").option("header", True).csv(f"{a.output}/trades")
    market.write_metrics(backtest.performance(rows, closed), f"{a.output}/performance")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(required=True)
    for name, run, options in (
        ("candles", candles, {"seconds": 13.0, "zone": "UTC"}), ("features", matrix, {"seconds": 5}),
        ("predict", predict, {"horizon": 300, "rounds": 50, "cost": 0.0}), ("backtest", simulate_trades, {"time": "ts"}),
    ):
        command = commands.add_parser(name, help=run.__doc__)
        command.add_argument("input")
        command.add_argument("output")
        for option, value in {"symbol": "BTC", **options}.items():
            command.add_argument(f"--{option}", type=type(value), default=value)
        command.set_defaults(run=run)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
