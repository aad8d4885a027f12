"""Figures of paths of steps: advantage estimates, ratios and drawdowns of a P&L path, and figures of many episodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series

YEAR_OF_MINUTES = 252 * 24 * 60
#: Steps that are composed in one task's group.
CHUNK = 100_000


def composed(a: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the composition of the maps x -> a + m x from it to the last row, by doubling."""
    a, m, step = a.copy(), m.copy(), 1
    while step < len(a):
        a[:-step] += m[:-step] * a[step:]
        m[:-step] *= m[step:]
        step *= 2
    return a, m


def reverse_scan(df: DataFrame, keys: list[str], order: str, add: str, factor: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with name(t) = add(t) + factor(t) name(t + 1) along each path, 0 after its end.

    Every row is an affine map. Chunks of a path compose theirs side by side into one map each; those, a row a chunk, are composed by path, and each
    chunk's rows then take what comes after it. A path may so fill as many tasks as it has chunks."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    place = [*keys, "_chunk"]

    def end(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        a, m = composed(*(table[c].to_numpy().astype(float) for c in (add, factor)))
        return table.select(place).slice(0, 1).append_column("_a", pa.array(a[:1])).append_column("_m", pa.array(m[:1]))

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        a, _ = composed(table["_a"].to_numpy(), table["_m"].to_numpy())
        return table.select(place).append_column("_next", pa.array(np.append(a[1:], 0.0)))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*place).schema)
    ends = rows.select(*place, order, add, factor).groupBy(*place).applyInArrow(end, f"{types}, _a double, _m double")
    carried = ends.groupBy(*keys).applyInArrow(carry, f"{types}, _next double")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        a, m = (table[c].to_numpy().astype(float) for c in (add, factor))
        a[-1] += m[-1] * table["_next"][0].as_py()
        m[-1] = 0.0
        return table.append_column(name, pa.array(composed(a, m)[0])).drop_columns(["_next", "_chunk"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.join(carried, place).select(*rows.columns, "_next").groupBy(*place).applyInArrow(fill, f"{fields}, `{name}` double")


def advantages(steps: DataFrame, keys: list[str], order: str, gamma: float = 0.99, lam: float = 0.95, chunk: int = CHUNK) -> DataFrame:
    """Adds advantage, target and the path's normalised advantage, from reward, value and done.

    adv(t) = d(t) + gamma lam (1 - done) adv(t + 1), d(t) = reward + gamma value(t + 1) - value, with value 0 after a done step and after
    the path's end. ``order`` is a number; chunks are ranges of it."""
    turned = steps.withColumn("_turn", -F.col(order))
    turned = series.lagged(turned, keys, ["_turn"], "_turn", chunk, "value", "_ahead")
    goes_on = F.when(F.col("done"), 0.0).otherwise(1.0)
    rows = turned.select(*steps.columns, (F.col("reward") + gamma * goes_on * F.coalesce("_ahead", F.lit(0.0)) - F.col("value")).alias("_delta"), (gamma * lam * goes_on).alias("_factor"))
    out = reverse_scan(rows, keys, order, "_delta", "_factor", "advantage", chunk).drop("_delta", "_factor")
    figures = out.groupBy(*keys).agg(F.avg("advantage").alias("_m"), F.stddev_pop("advantage").alias("_s"))
    return out.join(figures, keys).withColumns({"target": F.col("advantage") + F.col("value"), "advantage_norm": (F.col("advantage") - F.col("_m")) / (F.col("_s") + 1e-8)}).drop("_m", "_s")


def path_figures(steps: DataFrame, keys: list[str], order: str, pnl: str, chunk: int = CHUNK, change: str | None = None) -> DataFrame:
    """Final P&L, the Sharpe and Sortino ratios of its changes (minutes, annualised) and its greatest drawdown by path.

    The Sharpe ratio is 0 without two steps or any dispersion; the Sortino ratio is 10 without dispersion of losses (0 without two steps).
    A step's own ``change`` is taken where there is such a column (a path's first step has none before it); else neighbouring sums are subtracted, and
    differences within 1e-12 of them count as none, since sums of the same changes differ by as much."""
    paths = series.lagged(steps, keys, [order], order, chunk, pnl, "_before")
    d = F.col(pnl) - F.col("_before")
    d = F.when(F.col("_before").isNotNull(), F.col(change)) if change else F.when(F.abs(d) <= 1e-12 * F.greatest(F.abs(pnl), F.abs("_before")), 0.0).otherwise(d)
    paths = paths.withColumn("_d", d)
    paths = series.running(paths, keys, [order], order, chunk, {"_peak": ("max", pnl)})
    d = F.col("_d")
    out = paths.groupBy(*keys).agg(F.max(F.struct(order, F.col(pnl).alias("_p"))).alias("_end"), F.count(d).alias("_n"), F.avg(d).alias("_mean"), F.stddev_pop(d).alias("_sd"), F.stddev_pop(F.when(d < 0, d)).alias("_down"), F.max(F.col("_peak") - F.col(pnl)).alias("max_drawdown"))
    ratio = lambda b, other: F.when((F.col("_n") < 1) | F.col(b).isNull() | (F.col(b) == 0), other).otherwise(F.try_divide("_mean", b) * YEAR_OF_MINUTES**0.5)
    flat = F.when(F.col("_n") < 1, 0.0).otherwise(10.0)
    return out.select(*keys, F.col("_end._p").alias("final_pnl"), ratio("_sd", F.lit(0.0)).alias("sharpe"), ratio("_down", flat).alias("sortino"), "max_drawdown")


def fill_figures(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Of given fills (price, size, fee, is_maker, cost, the markout) by path: volumes, fees, maker share (0 without fills), share and mean of
    adverse ones."""
    volume = F.col("price") * F.col("size")
    out = fills.groupBy(*keys).agg(F.sum(F.when(F.col("is_maker"), volume).otherwise(0.0)).alias("maker_volume"), F.sum(F.when(F.col("is_maker"), 0.0).otherwise(volume)).alias("taker_volume"), F.sum("fee").alias("fees"), F.count_if(F.col("cost") > 0).alias("_bad"), F.count("*").alias("n_fills"), F.coalesce(F.avg("cost"), F.lit(0.0)).alias("mean_adverse_cost"))
    share = F.coalesce(series.safe_div(F.col("maker_volume"), F.col("maker_volume") + F.col("taker_volume")), F.lit(0.0))
    return out.withColumns({"maker_ratio": share, "adverse_ratio": F.col("_bad") / F.greatest("n_fills", F.lit(1))}).drop("_bad")


def means(episodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of every figure over the episodes."""
    return episodes.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def rolling_means(episodes: DataFrame, keys: list[str], order: str, columns: list[str], rows: int = 50) -> DataFrame:
    """Adds <c>_mean: each figure's mean over the last ``rows`` episodes, from the first on."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return episodes.withColumns({f"{c}_mean": F.avg(c).over(frame) for c in columns})


def write_episodes(episodes: DataFrame, order: list[str], path: str) -> None:
    """Episode figures as CSV with their number from 1 in the given order, a row an episode."""
    numbered = episodes.withColumn("episode", F.row_number().over(Window.orderBy(*order)))
    numbered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
