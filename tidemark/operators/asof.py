"""As-of joins, interval aggregates and labels, made of unions and windows in chunks of time instead of range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series

#: Chunks of time in which series are ordered side by side, in microseconds.
DAY = 86_400_000_000


def _stacked(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """Both tables' rows by time; of equal times the right ones come first, in their tie order."""
    l = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(None).cast("long").alias("_vt"), F.struct(*left.columns).alias("_row"))
    r = right.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_v"), F.col(at).alias("_vt"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    return l.unionByName(r)


def backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str, name: str, chunk: int = DAY) -> DataFrame:
    """``left`` with the ``value`` of the last right row at or before its time (by ``tie`` among equal times), null before the first."""
    mark = F.when(F.col("_side") == 0, F.struct("_v"))
    stacked = series.latest(_stacked(left, right, keys, at, value, tie), keys, ["_t", "_side", "_tie"], "_t", chunk, {"_found": mark})
    return stacked.where("_side = 1").select("_row.*", F.col("_found._v").alias(name))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str, name: str, chunk: int = DAY) -> DataFrame:
    """``left`` with the ``value`` and time (``name``_at) of the right row nearest in time; of two equally near the earlier, of
    right rows at one time the last looking back and the first looking ahead."""
    return _nearest(_stacked(left, right, keys, at, value, tie), keys, name, chunk)


def _nearest(stacked: DataFrame, keys: list[str], name: str, chunk: int) -> DataFrame:
    mark = F.when(F.col("_side") == 0, F.struct("_vt", "_v"))
    found = series.around(stacked, keys, ["_t", "_side", "_tie"], "_t", chunk, {"_b": mark}, {"_a": mark}).where("_side = 1")
    ahead = F.col("_b").isNull() | (F.col("_a._vt") - F.col("_t") < F.col("_t") - F.col("_b._vt"))
    pick = F.when(ahead, F.coalesce("_a", "_b")).otherwise(F.col("_b"))
    return found.withColumn("_p", pick).select("_row.*", F.col("_p._v").alias(name), F.col("_p._vt").alias(f"{name}_at"))


def over_interval(grid: DataFrame, ticks: DataFrame, keys: list[str], at: str, aggregates: dict[str, series.Trailing], chunk: int = DAY, tasks: int | None = None) -> DataFrame:
    """``grid`` with aggregates (kind, column, span) of the ticks in (t - span, t]. Grid rows enter the ticks' stream with null values,
    which the aggregates skip."""
    extra = [c for c in ticks.columns if c not in (*keys, at)]
    rows = ticks.select(*keys, at, *extra, F.lit(None).cast(grid.schema).alias("_row"))
    points = grid.select(*keys, at, *(F.lit(None).cast(dict(ticks.dtypes)[c]).alias(c) for c in extra), F.struct(*grid.columns).alias("_row"))
    return series.trailing(rows.unionByName(points), keys, at, chunk, aggregates, tasks).where("_row is not null").select("_row.*", *aggregates)


def labelled(bars: DataFrame, keys: list[str], at: str, price: str, horizon: int, chunk: int = DAY) -> DataFrame:
    """Bars with the price nearest to ``horizon`` microseconds ahead, its return and its label (1 where it rose).

    The last bars match the last row, so none is without a label."""
    kinds = dict(bars.dtypes)
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    # every bar is there twice, as one that asks for the price at its horizon and as one that has a price
    asks = F.struct((F.col(at) + horizon).alias("_t"), F.lit(1).alias("_side"), none("long", "_tie"), none(kinds[price], "_v"), none(kinds[at], "_vt"), F.struct(*bars.columns).alias("_row"))
    has = F.struct(F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(at).cast("long").alias("_tie"), F.col(price).alias("_v"), F.col(at).alias("_vt"), none(bars.schema, "_row"))
    stacked = bars.select(*keys, F.explode(F.array(asks, has)).alias("_s")).select(*keys, "_s.*")
    found = _nearest(stacked, keys, "future_price", chunk)
    change = F.try_divide(F.col("future_price"), F.col(price)) - 1
    return found.withColumnRenamed("future_price_at", "future_at").withColumn("return_pct", change).withColumn("label", (F.col("return_pct") > 0).cast("int"))
