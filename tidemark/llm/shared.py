"""The folder all executors share, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a mask of keys, which is broadcast: its size is bounded, whatever the number of keys.
WORDS = 1 << 18


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; only a local master without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The same rows read back from the shared checkpoint folder; in ``tasks`` parts at most, where a table is known to be small.

    The driver keeps figures of every task, and every part is a file: a table of a few rows in hundreds of parts costs both each time it is read."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df.coalesce(tasks) if tasks else df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in the shared checkpoint folder: smaller than ``cut`` where rows hold texts, and
    later reads take only the columns they need. The table lives as long as that folder."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    h = F.xxhash64(*keys)
    return df.withColumns({"_word": F.pmod(h, F.lit(WORDS)).cast("int"), "_bit": F.shiftrightunsigned(h, 58).cast("int")})


def split(df: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``df`` whose keys may be among those of ``rows``, those whose keys are not), told by a bit of each key's hash. Neither is shuffled, so that an exact
    join of the first part need not deal out all texts of ``df``. Keys of 2^24 rows and more would leave most of ``df`` in the first part."""
    masks = cut(_placed(rows, keys).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    told = _placed(df, keys).join(F.broadcast(masks), "_word", "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, _bit)")) != 0, F.lit(False))
    return told.where(may).select(*df.columns), told.where(~may).select(*df.columns)
