"""Time-bucketed candles and simple aggregates of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series


def bucket(us: Column, seconds: float) -> Column:
    """Beginning of the bucket, in microseconds since 1970."""
    step = int(seconds * 1_000_000)
    return (F.floor(us / step) * step).cast("long")


def candles(ticks: DataFrame, seconds: float) -> DataFrame:
    """Open, high, low, close, volume and tick count by symbol and bucket; open and close follow (time, trade id).

    One shuffle of partial aggregates: a bucket's ticks are combined where they are read."""
    order = F.struct("us", "trade_id")
    grouped = ticks.groupBy("symbol", bucket(F.col("us"), seconds).alias("bucket")).agg(
        F.min(F.struct("us", "trade_id", "price")).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(F.struct("us", "trade_id", "price")).alias("last"), F.sum("quantity").alias("volume"), F.count(order).alias("tick_count"),
    )
    return grouped.select("symbol", "bucket", F.col("first.us").alias("open_us"), F.col("last.us").alias("close_us"), F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume", "tick_count")


def timed(candle_table: DataFrame) -> DataFrame:
    """Candles with open_time and close_time as timestamps."""
    return candle_table.withColumns({"open_time": F.timestamp_micros("open_us"), "close_time": F.timestamp_micros("close_us")})


def valid(candle: DataFrame) -> DataFrame:
    """Adds is_valid: the extremes enclose open and close, there is a tick, and no negative volume."""
    inside = (F.col("high") >= F.greatest("low", "open", "close")) & (F.col("low") <= F.least("open", "close"))
    return candle.withColumn("is_valid", inside & (F.col("tick_count") > 0) & (F.col("volume") >= 0))


def totals(candle: DataFrame) -> DataFrame:
    """One row: candles, ticks, volume, extremes, and whether all are valid."""
    return valid(candle).agg(F.count("*").alias("n_candles"), F.sum("tick_count").alias("ticks"), F.sum("volume").alias("volume"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("is_valid").alias("all_valid"))


def last_candles(candle: DataFrame, n: int = 80) -> DataFrame:
    """Each symbol's n latest candles. Only n per task and symbol travel."""
    from pyspark.sql import Window

    latest = Window.partitionBy("symbol").orderBy(F.desc("bucket"))
    return candle.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n).drop("rank")


def resampled_mean(ticks: DataFrame, seconds: float) -> DataFrame:
    """Mean price by symbol and bucket; empty buckets are missing."""
    return ticks.groupBy("symbol", bucket(F.col("us"), seconds).alias("bucket")).agg(F.avg("price").alias("mid_price"))


def first_per_time(ticks: DataFrame, seconds: float = 0) -> DataFrame:
    """The first tick, by trade id, of each symbol and time (or bucket of ``seconds``)."""
    at = bucket(F.col("us"), seconds) if seconds else F.col("us")
    return series.first_rows(ticks.withColumn("bucket", at), ["symbol", "bucket"], ["us", "trade_id"])


def by_reason(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and count of a value by key, largest count first."""
    return df.groupBy(key).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n")).orderBy(F.desc("n"), key)


def by_hour(df: DataFrame, us: str, value: str) -> DataFrame:
    """Mean and count of a value for each of the 24 hours of the day, null and 0 where there is none."""
    hour = (F.floor(F.col(us) / 3_600_000_000) % 24).cast("int")
    found = df.groupBy(hour.alias("hour")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(found), "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # at most 24 rows


def summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, sum, mean, sample and population deviation, variance, extremes and median by key."""
    c = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.stddev_pop(c).alias("sd_pop"), F.var_samp(c).alias("variance"),
        F.min(c).alias("low"), F.max(c).alias("high"), F.median(c).alias("median"), F.avg(F.when(c > 0, c)).alias("mean_positive"), F.sum(F.when(c < 0, c).otherwise(0.0)).alias("sum_negative"),
    )


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal bins from the least to the greatest value, the last one closed; without bins that are empty."""
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if low is not None:
        span = span.withColumns({"low": F.lit(float(low)), "high": F.lit(float(high))})
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col(value) - F.col("low"), width)), F.lit(bins - 1)))
    return df.select(value).where(F.col(value).isNotNull()).join(F.broadcast(span)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("low").alias("range_low"), F.max("high").alias("range_high"))


def merged_stats(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and sample deviation (n, mean, sd) of two tables' rows together, by key: squares about the common mean, so that nothing large
    is subtracted from something as large."""
    both = stored.select(*keys, "n", "mean", "sd").unionByName(batch.select(*keys, "n", "mean", "sd"))
    base = both.groupBy(*keys).agg(F.min("mean").alias("_base"))  # a mean as origin keeps the weighted sum small
    near = both.join(base, keys).withColumn("_d", F.col("mean") - F.col("_base"))
    total = near.groupBy(*keys).agg(F.sum("n").alias("_n"), series.safe_div(F.sum(F.col("n") * F.col("_d")), F.sum("n")).alias("_m"))
    squares = F.pow(F.coalesce("sd", F.lit(0.0)), F.lit(2)) * (F.col("n") - 1) + F.col("n") * F.pow(F.col("_d") - F.col("_m"), F.lit(2))
    out = near.join(total, keys).groupBy(*keys).agg(F.first("_n").alias("n"), F.first(F.col("_base") + F.col("_m")).alias("mean"), F.sum(squares).alias("_q"))
    return out.select(*keys, "n", "mean", F.sqrt(series.safe_div(F.col("_q"), F.when(F.col("n") > 1, F.col("n") - 1))).alias("sd"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, extremes and approximate quartiles, all found in one pass."""
    figures = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "low": F.min, "high": F.max}
    one = df.agg(*(F.struct(*(f(c).cast("double").alias(n) for n, f in figures.items()), F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias("q")).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), *(F.col(f"{c}.{n}").alias(n) for n in figures), *(F.col(f"{c}.q")[k].cast("double").alias(q) for k, q in enumerate(("q25", "q50", "q75")))) for c in columns))).alias("r"))
    return rows.select("r.*").withColumn("n", F.col("n").cast("long"))
