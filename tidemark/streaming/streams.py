"""Streams of ticks and book messages: candles with late data, books as state, statistics by micro-batch, sessions and alerts."""

from __future__ import annotations

import heapq
import math
import time
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.candles import merged_stats
from tidemark.sources.market import exists

#: Rows of a micro-batch of ``in_order``, and of a frame that books are told in.
BATCH_ROWS, OUT_ROWS = 4_000_000, 10_000


def in_order(rows: DataFrame, order: str, path: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """A stream of a table in micro-batches of about ``batch_rows`` rows, those of the least ``order`` first.

    The rows are written to ``path`` by ranges of ``order``, a file a range, and the files are dated in that order, which the file source reads them in."""
    spark, n = rows.sparkSession, rows.count()
    rows.repartitionByRange(max(1, -(-n // batch_rows)), order).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = lambda: sorted((f for f in store.listStatus(hadoop(path)) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    now = int(time.time() * 1000)
    for k, file in enumerate(files()):
        store.setTimes(file.getPath(), now + 1000 * k, -1)
    dates = [f.getModificationTime() for f in files()]
    if any(a >= b for a, b in zip(dates, dates[1:], strict=False)):
        raise ValueError(f"files can't be dated in this store: {path}")
    # where a session asks for more ranges, a micro-batch takes several
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, len(dates) * batch_rows // max(1, n))).parquet(path)


def candles(ticks: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Candles by symbol and window of a stream with ts, price, quantity and trade_id.

    Ticks may come in any order; a window closes when the watermark passes it, and later ticks of it are dropped. Partial aggregates
    merge, so state holds one row a symbol and open window."""
    window = F.window("ts", f"{seconds} seconds")
    tick = F.struct("ts", "trade_id", "price")
    out = ticks.withWatermark("ts", lateness).groupBy("symbol", window.alias("w")).agg(F.min(tick).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(tick).alias("last"), F.sum("quantity").alias("volume"), F.count("*").alias("tick_count"))
    return out.select("symbol", F.col("w.start").alias("bucket"), F.col("first.ts").alias("open_time"), F.col("last.ts").alias("close_time"), F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume", "tick_count")


def versions(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for update mode: the rows that a micro-batch changed go to ``path``/batch=n; a batch that is retried
    writes the same folder again."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every row that ``versions`` wrote."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


def sessions(ticks: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Activity by symbol and session: runs of ticks with gaps below ``gap``."""
    return ticks.withWatermark("ts", lateness).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("quantity").alias("volume")).select("symbol", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "volume")


def alerts(ticks: DataFrame, seconds: int, lateness: str, max_range: float, max_ticks: int) -> DataFrame:
    """Windows whose relative price range or tick count exceed their limits."""
    c = candles(ticks, seconds, lateness)
    wide, busy = (F.col("high") - F.col("low")) > max_range * F.col("low"), F.col("tick_count") > max_ticks
    return c.where(wide | busy).select("symbol", "bucket", F.when(wide & busy, "range,rate").when(wide, "range").otherwise("rate").alias("reason"), "tick_count")


class _Levels:
    """One side of a book: its levels in memory while a micro-batch lasts; those that it changed are written to the state at its end.

    The best price is on top of a heap, from which prices that are gone are taken when they come up, so a message costs the logarithm of its levels. The depth is summed anew
    at each snapshot and at each micro-batch's beginning."""

    def __init__(self, state, sign: int):
        self.state, self.sign = state, sign
        self.saved = {k[0]: v[0] for k, v in state.iterator()}
        self.sizes = dict(self.saved)
        self.heap = [-sign * price for price in self.sizes]
        heapq.heapify(self.heap)
        self.depth = math.fsum(self.sizes.values())

    def clear(self) -> None:
        self.sizes, self.heap, self.depth = {}, [], 0.0

    def set(self, price: float, size: float, keep_zero: bool) -> None:
        new = price not in self.sizes
        self.depth -= self.sizes.pop(price, 0.0)
        if size or keep_zero:
            if new:
                heapq.heappush(self.heap, -self.sign * price)
            self.sizes[price] = size
            self.depth += size

    def best(self) -> float | None:
        while self.heap and -self.sign * self.heap[0] not in self.sizes:
            heapq.heappop(self.heap)
        return -self.sign * self.heap[0] if self.heap else None

    def save(self) -> None:
        for price in self.saved.keys() - self.sizes.keys():
            self.state.removeKey((price,))
        for price, size in self.sizes.items():
            if self.saved.get(price) != size:
                self.state.updateValue((price,), (size,))


class _Messages:
    """A symbol's messages of a micro-batch as columns of numbers, some 60 bytes a message of one level."""

    KINDS = ("delta", "snapshot", "trade")

    def __init__(self, frames: Iterator[pd.DataFrame]):
        self.seq, self.us, self.kind = array("q"), array("q"), array("b")
        self.first, self.bids, self.prices, self.sizes = array("q", [0]), array("i"), array("d"), array("d")
        for frame in frames:
            self.seq.extend(frame["seq"].tolist())
            self.us.extend(frame["us"].tolist())
            self.kind.extend(self.KINDS.index(t) if t in self.KINDS else 0 for t in frame["type"])
            for bids, asks in zip(frame["bids"], frame["asks"], strict=True):
                self.bids.append(len(bids))
                for level in (*bids, *asks):
                    self.prices.append(float(level["price"]))
                    self.sizes.append(float(level["size"]))
                self.first.append(len(self.prices))

    def by_seq(self) -> Iterator[tuple[int, int, str, list[tuple[float, float]], list[tuple[float, float]]]]:
        """seq, us, type, bids, asks; messages of one seq as they came."""
        for at in np.argsort(np.asarray(self.seq), kind="stable").tolist() if len(self.seq) else ():
            start, end = self.first[at], self.first[at + 1]
            levels, n = list(zip(self.prices[start:end], self.sizes[start:end], strict=True)), self.bids[at]
            yield self.seq[at], self.us[at], self.KINDS[self.kind[at]], levels[:n], levels[n:]


class _Books(StatefulProcessor):
    """Each symbol's levels as map state, a row a level, so that a micro-batch writes the levels it changes and no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = [handle.getMapState(side, "price double", "size double") for side in ("bids", "asks")]
        self.trade = handle.getValueState("trade", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        messages = _Messages(rows)
        sides = [_Levels(m, s) for m, s in zip(self.maps, (1, -1), strict=True)]
        before = trade = self.trade.get()[0] if self.trade.exists() else None
        out = []
        for seq, us, kind, *both in messages.by_seq():
            if kind == "trade":
                if levels := both[0] or both[1]:
                    trade = levels[0][0]
            else:
                for side, levels in zip(sides, both, strict=True):
                    if kind == "snapshot":
                        side.clear()
                    for price, size in levels:
                        side.set(price, size, kind == "snapshot")
            bid, ask = (s.best() for s in sides)
            mid = (bid + ask) / 2 if bid is not None and ask is not None else trade
            out.append((key[0], seq, us, bid, ask, mid, sides[0].depth, sides[1].depth))
            if len(out) == OUT_ROWS:
                yield self._frame(out)
                out = []
        for side in sides:
            side.save()
        if trade != before:
            self.trade.update((trade,))
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["symbol", "seq", "us", "best_bid", "best_ask", "mid", "bid_depth", "ask_depth"])

    def close(self) -> None:
        pass


def books(messages: DataFrame) -> DataFrame:
    """Best prices, mid and depths after each message of a stream (symbol, seq, us, type, bids, asks).

    A micro-batch's messages of a symbol are applied by seq; a task holds them as columns of numbers, so a long tape comes best in parts (``in_order``). Needs the
    RocksDB state store (``ROCKS``)."""
    schema = "symbol string, seq long, us long, best_bid double, best_ask double, mid double, bid_depth double, ask_depth double"
    return messages.groupBy("symbol").transformWithStateInPandas(_Books(), schema, "Append", "None")


#: Setting and value of the state store that books and histories need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Recent(StatefulProcessor):
    def __init__(self, value: str, n: int):
        self.value, self.n = value, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getListState("recent", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(rows).sort_values("seq")
        held = [v[0] for v in self.list.get()] if self.list.exists() else []
        values = pd.Series([*held, *frame[self.value].astype(float)])
        rolled = values.rolling(self.n, min_periods=1)
        out = pd.DataFrame({"symbol": key[0], "seq": frame["seq"].to_numpy(), "n": rolled.count().to_numpy()[len(held) :].astype("int64"), "mean": rolled.mean().to_numpy()[len(held) :]})
        self.list.put([(v,) for v in values.tail(self.n).tolist()])
        yield out

    def close(self) -> None:
        pass


def recent(rows: DataFrame, value: str, n: int) -> DataFrame:
    """symbol, seq, n, mean of the last ``n`` values at each row of a stream (symbol, seq, value): a bounded list as state."""
    return rows.groupBy("symbol").transformWithStateInPandas(_Recent(value, n), "symbol string, seq long, n long, mean double", "Append", "None")


def stats_by_batch(path: str, keys: list[str], value: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps count, mean and deviation by key in ``path``/v<batch>: the version before it, merged.

    A batch that is retried reads the same earlier version and writes the same one again."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
        if number:
            new = merged_stats(batch.sparkSession.read.parquet(f"{path}/v{number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge


class RunningScale:
    """Scales each micro-batch by mean and deviation of all rows so far, its own included; the statistics are a version a batch in ``path``/v<batch>.

    A batch that is retried reads the version before it and writes its own again, so its rows count once and are scaled alike. Missing values are not
    counted and stay missing; a feature that doesn't vary is only centred."""

    def __init__(self, path: str, features: list[str]):
        self.path, self.features = path, features

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        long = batch.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in self.features))).alias("x")).select("x.*")
        stats_by_batch(self.path, ["feature"], "value")(long, number)
        return self.scaled(batch, number)

    def statistics(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{number}")

    def scaled(self, rows: DataFrame, number: int) -> DataFrame:
        """``rows`` by the statistics of a version, with that version's number."""
        figure = lambda c, f: F.max(F.when(F.col("feature") == f, F.col(c)))
        row = self.statistics(rows.sparkSession, number).agg(*(figure(c, f).alias(f"_{c}_{f}") for f in self.features for c in ("mean", "sd")))
        out = rows.crossJoin(F.broadcast(row))  # one row of statistics
        out = out.withColumns({f: (F.col(f) - F.col(f"_mean_{f}")) / F.when(F.col(f"_sd_{f}") > 0, F.col(f"_sd_{f}")).otherwise(1.0) for f in self.features})
        return out.select(*rows.columns, F.lit(number).cast("long").alias("stats_version"))


class TrainThenScore:
    """A foreachBatch function that stores batches until ``rows`` rows are there, fits once, and scores every batch from then on.

    The fitted model (a pipeline model) is saved beside the batches it was fitted on; a stream that starts again loads it, so all
    batches are scored by one model. ``finish`` fits and scores what is stored when a stream ends before, given over ``least`` rows."""

    def __init__(self, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame], store: str, out: str, rows: int, least: int = 100):
        self.fit, self.score, self.store, self.out, self.rows, self.least = fit, score, store, out, rows, least

    def model(self, spark: SparkSession):
        from pyspark.ml import PipelineModel

        return PipelineModel.load(f"{self.store}/model") if exists(spark, f"{self.store}/model/metadata/_SUCCESS") else None

    def _fitted(self, spark: SparkSession, rows: int):
        stored = spark.read.parquet(f"{self.store}/batches").drop("batch")
        if stored.limit(rows).count() < rows:
            return None
        self.fit(stored).write().overwrite().save(f"{self.store}/model")
        return self.model(spark)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        model = self.model(spark)
        if model is None:
            batch.write.mode("overwrite").parquet(f"{self.store}/batches/batch={number}")
            model = self._fitted(spark, self.rows)
        if model is not None:
            self.score(model, batch).write.mode("overwrite").parquet(f"{self.out}/batch={number}")

    def finish(self, spark: SparkSession) -> None:
        if self.model(spark) is None and exists(spark, f"{self.store}/batches") and (model := self._fitted(spark, self.least + 1)):
            self.score(model, spark.read.parquet(f"{self.store}/batches").drop("batch")).write.mode("overwrite").parquet(f"{self.out}/batch=-1")


class NormaliseTrainThenScore(TrainThenScore):
    """``TrainThenScore`` on batches that ``RunningScale`` has scaled, in training and scoring alike. Scored rows tell the version of the statistics and that of the model, the
    number of the last batch it was fitted on."""

    def __init__(self, features: list[str], fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame], store: str, out: str, rows: int, least: int = 100):
        def versioned(model, df: DataFrame) -> DataFrame:
            fitted = df.sparkSession.read.parquet(f"{store}/batches").agg(F.max("batch").cast("long").alias("model_version"))  # folders' names alone
            return score(model, df).crossJoin(F.broadcast(fitted))

        super().__init__(fit, versioned, store, out, rows, least)
        self.scale = RunningScale(f"{store}/statistics", features)

    def __call__(self, batch: DataFrame, number: int) -> None:
        super().__call__(self.scale(batch, number), number)
