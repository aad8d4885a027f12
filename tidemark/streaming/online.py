"""The online side of a feature store: every key's last row, kept from a stream as a versioned, compacted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.market import exists


class OnlineTable:
    """A foreachBatch function that keeps the last row of every key, by ``order`` (columns that ascend and tell rows apart).

    A micro-batch writes the last row of the keys it has, as <path>/changes/batch=<n>; that is version n. Every ``every`` batches the table so far is written
    as a base, <path>/bases/v<n>, so a reader merges one base and fewer than ``every`` changes. Versions are whole once written and never written over: a
    retried batch finds its own there, and a reader who named a version sees the same rows whatever comes after. Late rows lose to newer ones."""

    def __init__(self, path: str, keys: list[str], order: list[str], every: int = 10):
        self.path, self.keys, self.order, self.every = path, keys, order, every

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not self._whole(spark, f"changes/batch={number}"):
            self._last(batch).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        if (number + 1) % self.every == 0 and not self._whole(spark, f"bases/v{number}"):
            self.read(spark, number).write.mode("overwrite").parquet(f"{self.path}/bases/v{number}")

    def _whole(self, spark: SparkSession, folder: str) -> bool:
        return exists(spark, f"{self.path}/{folder}/_SUCCESS")

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key, combined before the shuffle."""
        columns = rows.columns
        newest = F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_row")
        return rows.groupBy(*self.keys).agg(newest).select(*(F.col("_row")[c].alias(c) for c in columns))

    def _numbers(self, spark: SparkSession, folder: str, prefix: str) -> list[int]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def version(self, spark: SparkSession) -> int | None:
        """The newest version, null before the first."""
        return next((n for n in reversed(self._numbers(spark, "changes", "batch=")) if self._whole(spark, f"changes/batch={n}")), None)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table at a version, the newest if none is named."""
        version = self.version(spark) if version is None else version
        if version is None or not self._whole(spark, f"changes/batch={version}"):
            raise ValueError(f"no version {version} in {self.path}")
        base = next((n for n in reversed(self._numbers(spark, "bases", "v")) if n <= version and self._whole(spark, f"bases/v{n}")), None)
        after = [n for n in self._numbers(spark, "changes", "batch=") if (base is None or n > base) and n <= version]
        folders = [f"{self.path}/bases/v{base}"] * (base is not None) + [f"{self.path}/changes/batch={n}" for n in after]
        return self._last(spark.read.parquet(*folders))
