"""Readers of ticks, trades, order-book messages and features, writers of candles and partitioned tables, and the tick view of the tables."""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import stored

#: Aggregated trades, with a header line; timestamps in milliseconds.
AGGREGATED = T.StructType([T.StructField("aggTradeId", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType()), T.StructField("firstTradeId", T.LongType()), T.StructField("lastTradeId", T.LongType()), T.StructField("timestamp", T.LongType()), T.StructField("maker", T.StringType())])
#: Spot trades, without a header; timestamps in microseconds.
SPOT = T.StructType([T.StructField("trade_id", T.LongType()), T.StructField("price", T.FloatType()), T.StructField("quantity", T.FloatType()), T.StructField("trade_value", T.FloatType()), T.StructField("timestamp", T.StringType()), T.StructField("is_buyer_maker", T.StringType()), T.StructField("is_best_match", T.StringType())])
_LEVELS = T.ArrayType(T.ArrayType(T.StringType()))
#: Order-book messages, a JSON object a line; timestamps in milliseconds, prices and sizes as strings.
BOOK = T.StructType([T.StructField("type", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("data", T.StructType([T.StructField("b", _LEVELS), T.StructField("a", _LEVELS)]))])
#: Other names that price columns go by.
PRICE_NAMES = {"Open": ("open", "Open"), "High": ("high", "High"), "Low": ("low", "Low"), "Close": ("close", "Close", "adj close", "Adj Close"), "Volume": ("volume", "Volume")}


def flag(column: Column) -> Column:
    """True for 'True', 'true' and '1', false for anything else and null."""
    return F.coalesce(F.trim(column).isin("True", "true", "1"), F.lit(False))


def read_aggregated_trades(spark: SparkSession, path: str, symbol: str = "BTC") -> DataFrame:
    """Ticks of an aggregated-trade CSV; malformed lines are dropped. Only a trimmed 'True' is a maker."""
    raw = spark.read.schema(AGGREGATED).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return raw.where("timestamp is not null").select(F.lit(symbol).alias("symbol"), F.timestamp_millis("timestamp").alias("ts"), "price", F.col("qty").alias("quantity"), F.col("aggTradeId").alias("trade_id"), "firstTradeId", "lastTradeId", F.coalesce(F.trim("maker") == "True", F.lit(False)).alias("is_buyer_maker"))


def read_spot_trades(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trades of a headerless CSV with datetime and hour keys; malformed lines and unreadable times are dropped."""
    raw = spark.read.schema(SPOT).option("mode", "DROPMALFORMED").csv(path)
    micros = F.col("timestamp").try_cast("long")
    return raw.withColumn("timestamp", micros).withColumn("datetime", F.timestamp_micros("timestamp")).dropna(subset=["datetime"]).withColumns({"is_buyer_maker": flag(F.col("is_buyer_maker")), "is_best_match": flag(F.col("is_best_match")), "hour": F.date_format("datetime", "yyyyMMdd_HH")})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_hours(trades: DataFrame, path: str, file_rows: int = 5_000_000) -> None:
    """Parquet partitioned by hour, with first and last time and rows of every hour in <path>_manifest.

    An hour's rows are dealt to as many tasks as it has files, so a long hour is no single task's work."""
    manifest = hour_ranges(trades).withColumn("files", F.ceil(F.col("n_rows") / file_rows))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}_manifest")  # a row an hour
    files = trades.sparkSession.read.json(f"{path}_manifest").select("hour", "files")
    dealt = trades.join(F.broadcast(files), "hour").withColumn("salt", F.pmod(F.xxhash64("timestamp", "trade_id"), F.col("files")))
    dealt.repartition("hour", "salt").drop("files", "salt").write.partitionBy("hour").option("compression", "snappy").option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(path)


def load_trades(spark: SparkSession, csv_path: str) -> DataFrame:
    """Trades from ``<csv_path>_parquet``, which is written from the CSV the first time.

    A table without a manifest, or with other rows an hour than its manifest says, is set aside as <path>_backup_<n> and written anew."""
    target = f"{csv_path}_parquet"
    if exists(spark, target):
        if exists(spark, f"{target}/_SUCCESS") and exists(spark, f"{target}_manifest/_SUCCESS"):
            found = spark.read.parquet(target)
            told = spark.read.json(f"{target}_manifest").select("hour", "n_rows")
            counted = found.groupBy(F.col("hour").cast("string").alias("hour")).agg(F.count("*").alias("n"))
            if not counted.join(told, "hour", "full_outer").where(~F.col("n").eqNullSafe(F.col("n_rows"))).limit(1).count():
                return found
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        number = next(k for k in itertools.count(1) if not exists(spark, f"{target}_backup_{k}"))
        store.rename(hadoop(target), hadoop(f"{target}_backup_{number}"))
    write_hours(read_spot_trades(spark, csv_path), target)
    return spark.read.parquet(target)


def read_hour(spark: SparkSession, path: str, hour: str, columns: list[str]) -> DataFrame:
    """Some columns of one hour: the other hours' folders and columns aren't read."""
    return spark.read.parquet(path).where(F.col("hour") == hour).select(*columns)


def hour_ranges(trades: DataFrame, time: str = "datetime") -> DataFrame:
    """First and last time and rows of each hour."""
    return trades.groupBy("hour").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_rows"))


def footer_ranges(spark: SparkSession, path: str, time: str = "timestamp") -> DataFrame:
    """First and last ``time`` (a number, such as microseconds) and rows of each hour of a table by hours, from the statistics in its files' footers: no column is read.

    The table of a row an hour is stored; the session's settings are put back."""
    asked = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        return stored(footer_plan(spark, path, time), "ranges")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def footer_plan(spark: SparkSession, path: str, time: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("hour").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_rows"))


def read_between(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Trades of a table that ``write_hours`` wrote with first <= datetime <= last (UTC or the session's zone). The manifest tells the hours that reach into that span,
    and the scan is given these folders alone."""
    a, b = (F.lit(x).cast("timestamp") for x in (first, last))
    hours = spark.read.json(f"{path}_manifest").where((F.col("last_time").cast("timestamp") >= a) & (F.col("first_time").cast("timestamp") <= b)).select("hour")
    trades = spark.read.option("basePath", path).parquet(path).withColumn("hour", F.col("hour").cast("string"))
    return trades.join(hours, "hour", "left_semi").where(F.col("datetime").between(a, b))


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Name and length of a file, or of a folder's files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().toString(): f.getLen() for f in store.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", "."))}


def _finish(spark: SparkSession, target: str, chunk: str, files: dict[str, int]) -> None:
    """The record that makes a chunk part of the table."""
    spark.createDataFrame([(chunk, f, n) for f, n in files.items()], "chunk string, file string, bytes long").coalesce(1).write.json(f"{target}_done/{chunk}")


def convert_in_chunks(spark: SparkSession, csv_folder: str, target: str, chunk_bytes: int = 64 << 30) -> DataFrame:
    """The trades of a folder's CSV files as Parquet by chunk and hour, a chunk of about ``chunk_bytes`` of files at a time.

    A chunk counts once its record is in <target>_done, which is written after its rows and its hours' ranges. Called again after a stop, or with more files in the
    folder, finished files are skipped, rows without a record stay unread, and only the rest is converted. A finished file of another length is an error."""
    files = _files(spark, csv_folder)
    done = {r["file"]: r["bytes"] for r in spark.read.json(f"{target}_done/*").collect()} if exists(spark, f"{target}_done") else {}  # a row a file
    if changed := [f for f, n in done.items() if files.get(f, n) != n]:
        raise ValueError(f"changed since it was converted: {changed[0]}")
    chunks: list[dict[str, int]] = []
    for name in sorted(files.keys() - done.keys()):
        if not chunks or sum(chunks[-1].values()) + files[name] > chunk_bytes:
            chunks.append({})
        chunks[-1][name] = files[name]
    for part in chunks:
        chunk = uuid.uuid4().hex
        out = f"{target}/chunk={chunk}"
        read_spot_trades(spark, list(part)).hint("rebalance", "hour").write.partitionBy("hour").option("maxRecordsPerFile", 5_000_000).parquet(out)
        footer_ranges(spark, out).coalesce(1).write.json(f"{target}_ranges/chunk={chunk}")
        _finish(spark, target, chunk, part)
    return read_converted(spark, target)


def _finished(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("chunk string").json(f"{target}_done/*").distinct()


def read_converted(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all finished chunks."""
    rows = spark.read.parquet(target)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("chunk", "hour")}).join(F.broadcast(_finished(spark, target)), "chunk", "left_semi").drop("chunk")  # a row a chunk


def converted_ranges(spark: SparkSession, target: str) -> DataFrame:
    """The manifest of all finished chunks: hour, first_time, last_time (microseconds), n_rows."""
    ranges = spark.read.json(f"{target}_ranges").withColumns({c: F.col(c).cast("string") for c in ("chunk", "hour")}).join(F.broadcast(_finished(spark, target)), "chunk", "left_semi")
    return ranges.groupBy("hour").agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.sum("n_rows").alias("n_rows"))


def read_book_messages(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots and deltas of JSON lines; lines that can't be read, other types, and empty times or data are skipped."""
    return valid_messages(spark.read.schema(BOOK).option("mode", "PERMISSIVE").json(path))


def valid_messages(messages: DataFrame) -> DataFrame:
    return messages.where("type in ('snapshot', 'delta') and ts is not null and ts <> 0 and data is not null and (data.b is not null or data.a is not null)")


def read_features(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A feature table in Parquet or CSV, by its ending. A CSV without a schema is read twice, once to find its types."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column: {', '.join(missing)}")
    return df


def price_columns(df: DataFrame) -> DataFrame:
    """Columns renamed to Open, High, Low, Close, Volume: by their usual names, else by the first level of a header of several (``Close_SPY``,
    ``('Close', 'SPY')``), else capitalised, else by their places where there are just five columns of numbers. An error names those missing."""
    names: dict[str, str] = {}
    first_level = {c: re.split(r"[^A-Za-z ]+", c.strip("(' \""))[0].strip() for c in df.columns}
    for wanted, others in PRICE_NAMES.items():
        found = next((o for o in (wanted, *others) if o in df.columns), None)
        found = found or next((c for c, level in first_level.items() if level in (wanted, *others)), None)
        found = found or next((c for c in df.columns if c.capitalize() == wanted), None)
        if found:
            names[found] = wanted
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
    if not names and len(numbers) == len(PRICE_NAMES):
        names = dict(zip(numbers, PRICE_NAMES, strict=True))
    return require(df.withColumnsRenamed(names), PRICE_NAMES).dropna(subset=list(PRICE_NAMES))


def load_bars(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Bars of a file with usual price columns, rows with gaps dropped; an error where fewer than ``least`` are left."""
    bars = price_columns(read_features(spark, path))
    if bars.limit(least).count() < least:
        raise ValueError(f"fewer than {least} bars: {path}")
    return bars


def first_lines(spark: SparkSession, path: str, size: int = 5 << 20) -> DataFrame:
    """The whole lines (value) within a text file's first ``size`` bytes, for a sample file; they are at most ``size`` rows."""
    lines = spark.read.text(path).limit(size).withColumn("_id", F.monotonically_increasing_id())
    so_far = F.sum(F.octet_length("value") + 1).over(Window.orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_end", so_far).where(F.col("_end") <= size).select("value")


def random_ticks(spark: SparkSession, n: int, start: str = "2024-06-05 04:30:00", seed: int = 42, price: tuple[float, float] = (70000.0, 100.0), quantity: tuple[float, float] = (0.1, 0.2)) -> DataFrame:
    """n ticks at random times of ten minutes, normal prices and sizes with floors, makers alternating, by time."""
    return spark.range(n).select(
        F.lit("BTC").alias("symbol"), F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.rand(seed) * 600_000_000).cast("long")).alias("ts"),
        F.greatest(F.randn(seed + 1) * price[1] + price[0], F.lit(0.01)).alias("price"), F.greatest(F.randn(seed + 2) * quantity[1] + quantity[0], F.lit(1e-5)).alias("quantity"),
        F.col("id").alias("trade_id"), (F.col("id") % 2 == 0).alias("is_buyer_maker"),
    ).orderBy("ts", "trade_id")


def from_random_start(messages: DataFrame, order: str, seed: int = 0, share: float = 0.8) -> DataFrame:
    """The messages from a random place in the first ``share`` of the order."""
    place = messages.agg((F.min(order) + F.floor(F.rand(seed) * share * (F.max(order) - F.min(order)))).alias("start"))
    return messages.join(F.broadcast(place), F.col(order) >= F.col("start")).drop("start")


def time_grid(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """A dense grid from the first to the last time, rounded down to ``seconds``: grid_idx, timestamp, prev_timestamp, hour.

    The grid is laid out by ``range``, so it has no single row that holds all of it."""
    step = seconds * 1_000_000
    low, high = df.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "grid_idx long, timestamp timestamp, prev_timestamp timestamp, hour string")
    first = low // step * step
    grid = df.sparkSession.range((high - first) // step + 1).withColumnRenamed("id", "grid_idx")
    at = F.timestamp_micros(F.lit(first) + F.col("grid_idx") * step)
    return grid.select("grid_idx", at.alias("timestamp"), F.timestamp_micros(F.lit(first) + (F.col("grid_idx") - 1) * step).alias("prev_timestamp"), F.date_format(at, "yyyyMMdd_HH").alias("hour"))


def candle_lines(candles: DataFrame, zone: str = "UTC") -> DataFrame:
    """Candles with times written in a zone, as the CSV sink has them."""
    shown = lambda c: F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd HH:mm:ss.SSS")
    return candles.withColumns({"open_time": shown("open_time"), "close_time": shown("close_time")}).select("open_time", "close_time", "open", "high", "low", "close", "volume", "tick_count")


def write_candles(candles: DataFrame, path: str, zone: str = "UTC") -> None:
    candle_lines(candles.orderBy("symbol", "open_time"), zone).write.mode("overwrite").option("header", True).csv(path)


def write_months(features: DataFrame, path: str, time: str = "timestamp") -> None:
    """A feature table by month, doubles stored as floats; beside it <path>_metadata (rows, first and last time, columns) and <path>_described
    (count, mean, deviation, extremes and quartiles of each column of numbers)."""
    from tidemark.operators.candles import described

    narrow = features.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in features.dtypes))
    narrow.withColumn("month", F.date_format(time, "yyyyMM")).write.mode("overwrite").partitionBy("month").parquet(path)
    stored = features.sparkSession.read.parquet(path)
    meta = stored.agg(F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")).withColumn("columns", F.array(*map(F.lit, features.columns)))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}_metadata")
    described(stored, [c for c, t in stored.dtypes if t in ("double", "float", "bigint", "int") and c != "month"]).coalesce(1).write.mode("overwrite").json(f"{path}_described")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A few rows of metrics as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions as Parquet and their metrics as JSON, in folders of ``path``."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    write_metrics(metrics, f"{path}/metrics")


def read_config(path: str, defaults: dict) -> dict:
    """A JSON file's values over the defaults."""
    with open(path, encoding="utf-8") as file:
        return {**defaults, **json.load(file)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The events as ticks: symbol, ts, us (microseconds), price, quantity, trade_id, is_buyer_maker."""
    events = table(spark, folder, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(
        F.col("event_type").alias("symbol"), F.timestamp_micros(us).alias("ts"), us.alias("us"), F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"), F.col("event_id").alias("trade_id"), (F.col("user_id") % 2 == 1).alias("is_buyer_maker"),
    )
