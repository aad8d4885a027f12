"""Microstructure features of ticks on a time grid, normalisation and feature checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators.asof import backward, over_interval
from tidemark.operators.candles import bucket, first_per_time

PERIODS = (5, 10, 20, 40, 60, 120)
EPS = 1e-9
US = 1_000_000
DAY = 86_400 * US


def _imbalance(prefix: str) -> Column:
    buy, sell = F.col(f"{prefix}_buy"), F.col(f"{prefix}_sell")
    return (buy - sell) / (buy + sell + EPS)


def sided(ticks: DataFrame) -> DataFrame:
    """Ticks with buy and sell: the quantity where a buyer, or a seller, took the price."""
    return ticks.withColumns({"buy": F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0), "sell": F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0)})


def tick_windows(ticks: DataFrame, step: int, obi: int = 30, short: int = 60, long: int = 600, chunk_seconds: int | None = None) -> DataFrame:
    """The first tick of each time with flow and arrivals of the last ``step`` seconds, book imbalance of the last ``obi``, and the
    volatility of tick returns over ``short`` against ``long`` seconds (left edges open).

    Spans run in chunks of time, so one symbol fills as many tasks as it has chunks; without ``chunk_seconds`` they are as short as the ticks are dense."""
    chunk, tasks = (chunk_seconds * US, None) if chunk_seconds else series.chunk_for(ticks, ["symbol"], "us", 20 * max(step, obi, short, long) * US)
    once = first_per_time(ticks).drop("bucket")
    priced = series.lagged(once, ["symbol"], ["us", "trade_id"], "us", chunk, "price", "before")
    rows = sided(priced).withColumn("ret", series.safe_div(F.col("price"), F.col("before")) - 1)
    asked = {
        "tfi_buy": ("sum", "buy", step * US), "tfi_sell": ("sum", "sell", step * US), "arrivals": ("count", "price", step * US), "obi_buy": ("sum", "buy", obi * US),
        "obi_sell": ("sum", "sell", obi * US), "sd_short": ("stddev_samp", "ret", short * US), "sd_long": ("stddev_samp", "ret", long * US),
    }
    windowed = series.trailing(rows.select("symbol", "us", "trade_id", "price", "buy", "sell", "ret"), ["symbol"], "us", chunk, asked, tasks)
    return windowed.select("symbol", "us", "trade_id", "price", _imbalance("tfi").alias("tfi"), _imbalance("obi").alias("obi"), (F.col("arrivals") / step).alias("arrival_rate"), (F.col("sd_short") / (F.col("sd_long") + EPS)).alias("volatility_cluster"))


def feature_matrix(ticks: DataFrame, step: int, periods: tuple[int, ...] = PERIODS, span: int = 12, obi: int = 30, short: int = 60, long: int = 600, chunk_seconds: int | None = None, chunk_rows: int = 20_000) -> DataFrame:
    """One row a symbol and non-empty bucket of ``step`` seconds: mid_price and the features, nulls filled with 0.

    A tick's values hold from its time on: a bucket takes those of the tick at its beginning, or else of the last tick before.
    The mean price of a bucket lies after its beginning, so mid_price, momentum and volatility look one bucket ahead. Windows over
    buckets run in chunks of ``chunk_rows`` of them."""
    primitive = ["tfi", "obi", "arrival_rate", "volatility_cluster"]
    rows = tick_windows(ticks, step, obi, short, long, chunk_seconds).withColumn("bucket", bucket(F.col("us"), step))
    values = F.struct(*primitive)
    grid = rows.groupBy("symbol", "bucket").agg(
        F.avg("price").alias("mid_price"), F.max(F.struct("us", values.alias("v"))).alias("end"), F.max(F.when(F.col("us") == F.col("bucket"), values)).alias("at"))
    fast = [p for p in periods if p in (30, 60, 90, 120)]

    def body(grid: DataFrame, w: WindowSpec) -> DataFrame:
        grid = grid.withColumn("v", F.coalesce("at", F.lag("end.v").over(w))).select("*", *(F.col(f"v.{p}").alias(f"feature_{p}") for p in primitive))
        grid = grid.withColumn("ret", series.change("mid_price", w))
        grid = grid.withColumns({"feature_vol_of_vol_1m": series.rolling(F.stddev_samp, "feature_volatility_cluster", w, span), "obi_mean": series.rolling(F.avg, "feature_obi", w, span)})
        grid = grid.withColumns({"feature_obi_accel": series.change("obi_mean", w, span)} | {f"feature_momentum_{p}": series.change("mid_price", w, p) for p in periods} | {f"feature_volatility_{p}": series.rolling(F.stddev_samp, "ret", w, p) for p in periods})
        return grid.withColumns({f"feature_momentum_{p}_acceleration": series.change(f"feature_momentum_{p}", w, span) for p in fast} | {
            "feature_vol_weighted_obi": F.col("feature_obi") * F.col("feature_volatility_cluster"), "feature_arrival_weighted_tfi": F.col("feature_arrival_rate") * F.col("feature_tfi")})

    grid = series.in_row_chunks(grid, ["symbol"], ["bucket"], "bucket", DAY * 30, chunk_rows, max(periods) + 2 * span + 1, body)
    order = ["mid_price", *(f"feature_{p}" for p in primitive), "feature_vol_of_vol_1m", "feature_obi_accel", *(f"feature_{k}_{p}" for p in periods for k in ("momentum", "volatility")), *(f"feature_momentum_{p}_acceleration" for p in fast), "feature_vol_weighted_obi", "feature_arrival_weighted_tfi"]
    return grid.select("symbol", "bucket", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in order))


def dense_grid(ticks: DataFrame, step: int) -> DataFrame:
    """symbol, us: every multiple of ``step`` seconds from each symbol's first time, rounded down, to its last. Days are laid out first, so that no
    row holds a long array."""
    micros = step * US
    ends = ticks.groupBy("symbol").agg((F.floor(F.min("us") / micros) * micros).alias("lo"), F.max("us").alias("hi"))
    run = max(1, DAY // micros) * micros
    runs = ends.select("symbol", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(run))).alias("lo"))
    return runs.select("symbol", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + run - micros, F.col("hi")), F.lit(micros))).alias("us"))


def tick_balance(ticks: DataFrame, rows: int, chunk: int, chunk_rows: int = 100_000) -> DataFrame:
    """Ticks with ups and downs: how many of the last ``rows`` ticks, this one included, were above or below the tick before; and n, their number."""
    before = series.lagged(ticks, ["symbol"], ["us", "trade_id"], "us", chunk, "price", "before")
    moved = before.withColumns({"up": (F.col("price") > F.col("before")).cast("int"), "down": (F.col("price") < F.col("before")).cast("int")})
    last = lambda c: lambda w: c.over(w.rowsBetween(-(rows - 1), 0))
    return series.rolled(moved, ["symbol"], ["us", "trade_id"], "us", chunk, chunk_rows, rows, {"ups": last(F.sum("up")), "downs": last(F.sum("down")), "n": last(F.count(F.lit(1)))})


def grid_features(ticks: DataFrame, step: int, ticks_back: int = 20, sample: bool = False, near: int | None = None, spread: int = 60, average: int = 12, chunk_seconds: int | None = None) -> DataFrame:
    """The older feature set on the dense grid of every symbol. Of the ticks up to a grid time: imbalance of volume in the last ``near`` seconds
    (the greater of 30 and three steps by default); flow, price range and arrivals since the grid time before; deviation of the prices in the last
    ``spread`` seconds against its mean of ``average`` grid times; imbalance of the up and down moves of the last ``ticks_back`` ticks.

    ``sample`` takes sample deviations and one tick more, and at least two ticks for their imbalance, as the first version did."""
    near, micros, share = near or max(30, 3 * step), step * US, lambda a, b: F.coalesce(series.safe_div(a - b, a + b), F.lit(0.0))
    chunk, tasks = (chunk_seconds * US, None) if chunk_seconds else series.chunk_for(ticks, ["symbol"], "us", 100 * max(near, step, spread) * US)
    grid = dense_grid(ticks, step)
    asked = {
        "near_buy": ("sum", "buy", near * US), "near_sell": ("sum", "sell", near * US), "buy": ("sum", "buy", micros), "sell": ("sum", "sell", micros), "n": ("count", "price", micros),
        "high": ("max", "price", micros), "low": ("min", "price", micros), "sd": ("stddev_samp" if sample else "stddev_pop", "price", spread * US), "n_spread": ("count", "price", spread * US),
    }
    rows = over_interval(grid, sided(ticks).select("symbol", "us", F.col("price").alias("price"), F.col("buy"), F.col("sell")), ["symbol"], "us", asked, chunk, tasks)
    moves = tick_balance(ticks, ticks_back + sample, chunk).withColumn("moves", F.when(F.col("n") > int(sample), F.struct("ups", "downs")))
    rows = backward(rows, moves.select("symbol", "us", "trade_id", "moves"), ["symbol"], "us", "moves", "trade_id", "moves", chunk)
    rows = rows.withColumn("sd", F.when(F.col("n_spread") > 1, F.col("sd")).otherwise(0.0))
    mean = lambda d, c: d.withColumn("mean_sd", F.avg("sd").over(series.ordered(["symbol", c], ["us"]).rowsBetween(-(average - 1), 0)))
    rows = series.with_halo(rows, "us", max(chunk, average * micros), average * micros, mean)
    return rows.select(
        "symbol", F.col("us").alias("bucket"), share(F.col("near_buy"), F.col("near_sell")).alias("order_book_imbalance"), share(F.col("buy"), F.col("sell")).alias("trade_flow_imbalance"),
        F.when(F.col("mean_sd") > 0, F.col("sd") / F.col("mean_sd")).otherwise(1.0).alias("volatility_cluster"), F.when(F.col("n") > 1, F.col("high") - F.col("low")).otherwise(0.0).alias("spread_proxy"),
        (F.col("n") / step).alias("trade_arrival_rate"), share(F.col("moves.ups"), F.col("moves.downs")).alias("tick_imbalance"),
    )


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int") and c not in but]


def normalised(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None, limit: float = 5.0) -> DataFrame:
    """Adds <c>_norm: (c - mean) / (sample deviation + 1e-8) within +-limit; the statistics are one row, from ``fitted_on`` if given."""
    base = df if fitted_on is None else fitted_on
    stats = base.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    scaled = {f"{c}_norm": F.greatest(F.least((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8), F.lit(limit)), F.lit(-limit)) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def split_by_time(df: DataFrame, keys: list[str], order: list[str], shares: dict[str, float]) -> DataFrame:
    """Adds part: the first share of each series' rows, then the next, by position (shares cumulate, the last takes the rest)."""
    w = series.ordered(keys, order)
    place, total = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    names, limit, cases = list(shares), 0.0, []
    for name in names[:-1]:
        limit += shares[name]
        cases.append((F.floor(total * limit), name))
    part = reduce(lambda c, x: c.when(place <= x[0], F.lit(x[1])), cases[1:], F.when(place <= cases[0][0], F.lit(cases[0][1]))).otherwise(names[-1])
    return df.withColumn("part", part)


def _share(key: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def sampled(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """About a ``fraction`` of the rows, the same whatever the partitions."""
    return df.where(_share(key, seed) < fraction)


def split_at_random(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds part: shares of the rows at random (they cumulate, the last takes the rest), the same whatever the partitions."""
    names, limit, part = list(shares), 0.0, None
    for name in names[:-1]:
        limit += shares[name]
        part = F.when(F.col("_share") < limit, name) if part is None else part.when(F.col("_share") < limit, name)
    return df.withColumn("_share", _share(key, seed)).withColumn("part", F.lit(names[-1]) if part is None else part.otherwise(names[-1])).drop("_share")
