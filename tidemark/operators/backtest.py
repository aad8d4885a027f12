"""Positions with stops and targets, trades, sizing, costs, returns and performance of a long-only strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators import chains, crossing
from tidemark.operators.indicators import YEAR_OF_MINUTES, Settings
from tidemark.sources.shared import stored

#: Chunks of time in which rows are numbered side by side, in microseconds.
CHUNK = 30 * 86_400_000_000
#: Bars whose last entry and next signal are looked up side by side.
ROWS = 20_000


def positions(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bars with signal, atr, z_score and rsi, plus final_signal, entry, stop and target price, trade_id and exit_reason.

    A position is entered at a bar with signal 1 and left at the first bar after the holding period that reaches its stop or target, has signal 0 or
    passes the exit levels of z_score or rsi, the first of these that holds being the reason; the next is entered at the first bar with
    signal 1 after the cooldown. All bars with signal 1 look side by side for the bar at which a position entered there would end
    (``crossing``) and so for the one that would follow it; the chain from a symbol's first signal on tells which were entered (``chains``)."""
    columns = df.columns
    bars = stored(chains.numbered(df, ["symbol"], ["us"], "us", CHUNK, "_row"), "bars")
    above = lambda c, level: F.coalesce((F.col(c) > level) & ~F.isnan(c), F.lit(False))
    leaves = (F.col("signal") == 0) | above("z_score", s.z_exit) | above("rsi", s.rsi_exit)
    entry = {"_stop": F.col("close") - s.stop_loss * F.col("atr"), "_target": F.col("close") + s.take_profit * F.col("atr")}
    could = bars.where("signal = 1").select("symbol", "_row", F.col("close").alias("_entry"), *(v.alias(n) for n, v in entry.items()))
    limits = could.withColumns({"_since": F.col("_row") + max(s.min_hold, 1), "_negative": -F.col("_target"), "_zero": F.lit(0.0)})
    values = bars.select("symbol", "_row", "low", (-F.col("high")).alias("_high"), F.when(leaves, 0.0).otherwise(1.0).alias("_leaves"))
    exits = crossing.first_at_most(limits, values, ["symbol"], ["_row"], "_since", "_row", {"low": "_stop", "_high": "_negative", "_leaves": "_zero"}, "_exit")
    signals = series.latest(bars.select("symbol", "_row", "signal"), ["symbol"], ["_row"], "_row", ROWS, {"_next": F.when(F.col("signal") == 1, F.col("_row"))}, ahead=True).select("symbol", F.col("_row").alias("_free"), "_next")
    links = stored(exits.withColumn("_free", F.col("_exit") + max(s.cooldown, 1)).join(signals, ["symbol", "_free"], "left").select("symbol", "_row", "_exit", "_next"), "position-links")
    first = could.groupBy("symbol").agg(F.min("_row").alias("_row"))
    chain = bars.select("symbol", "_row").join(links, ["symbol", "_row"], "left")
    entered = chains.followed(chain, ["symbol"], "_row", "_next", first)
    taken = chains.numbered(entered.join(links, ["symbol", "_row"]).join(could, ["symbol", "_row"]), ["symbol"], ["_row"], "_row", ROWS, "_number").select("symbol", "_row", F.struct((F.col("_number") + 1).alias("trade"), "_row", "_exit", "_entry", "_stop", "_target").alias("_opens"))
    rows = series.latest(bars.join(taken, ["symbol", "_row"], "left"), ["symbol"], ["_row"], "_row", ROWS, {"_p": F.col("_opens")})
    p = F.col("_p")
    ends = F.coalesce(F.col("_row") == p["_exit"], F.lit(False))
    within = p.isNotNull() & (p["_exit"].isNull() | (F.col("_row") <= p["_exit"]))
    reached = lambda c: F.coalesce(c & ~F.isnan(p["_stop"]), F.lit(False))
    reason = F.when(reached(F.col("low") <= p["_stop"]), "stop_loss").when(reached((F.col("high") >= p["_target"]) & ~F.isnan("high")), "take_profit").when(F.col("signal") == 0, "signal").otherwise("indicator_exit")
    return rows.select(
        *columns, F.when(within & ~ends, 1).otherwise(0).alias("final_signal"), *(F.when(within, p[f"_{c}"]).alias(f"{c}_price") for c in ("entry", "stop", "target")),
        F.when(within, p["trade"]).otherwise(0).cast("long").alias("trade_id"), F.when(within & ends, reason).otherwise("").alias("exit_reason"),
    )


def trades(df: DataFrame) -> DataFrame:
    """Finished trades by symbol and trade_id: entry and exit time and price, pnl_pct, duration_minutes, exit_reason."""
    of = df.where("trade_id > 0").groupBy("symbol", "trade_id").agg(
        F.min(F.struct("us", "entry_price")).alias("entry"), F.min(F.when(F.col("exit_reason") != "", F.struct("us", "close", "exit_reason"))).alias("exit"))
    return of.where("exit is not null").select(
        "symbol", "trade_id", F.col("entry.us").alias("entry_us"), F.col("exit.us").alias("exit_us"), F.col("entry.entry_price").alias("entry_price"), F.col("exit.close").alias("exit_price"),
        (F.col("exit.close") / F.col("entry.entry_price") - 1).alias("pnl_pct"), ((F.col("exit.us") - F.col("entry.us")) / 60_000_000).alias("duration_minutes"), F.col("exit.exit_reason").alias("exit_reason"),
    )


def sized(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds position (a share of capital, priced at close) and position_change; size is set at entry by risk and capped."""
    trade = Window.partitionBy("symbol", "trade_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    shares = F.least(F.lit(s.risk) / (F.first(series.guarded(F.col("atr"))).over(trade) * s.stop_loss), F.lit(s.max_position) / F.first("entry_price").over(trade))
    w = series.ordered(["symbol"], ["us"])
    df = df.withColumn("shares", F.when(F.col("trade_id") > 0, shares))
    df = df.withColumn("position", F.coalesce(F.col("final_signal") * F.col("shares") * F.col("close"), F.lit(0.0)))
    return df.withColumn("position_change", F.coalesce(F.col("position") - F.lag("position").over(w), F.lit(0.0)))


def costed(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds slippage (scaled by ATR over its median), executed_price, shares_traded and transaction_cost."""
    medians = df.groupBy("symbol").agg(F.median("atr").alias("median_atr"))
    w = series.ordered(["symbol"], ["us"])
    df = df.join(medians, "symbol").withColumn("slippage", s.slippage * (1 + F.col("atr") / F.when(F.col("median_atr") > 0, F.col("median_atr")).otherwise(1e-9)))
    side = F.when(F.col("position_change") > 0, 1).when(F.col("position_change") < 0, -1).otherwise(0)
    df = df.withColumns({"executed_price": F.col("close") * (1 + side * F.col("slippage")), "held": F.coalesce(series.safe_div(F.col("position"), F.col("close")), F.lit(0.0))})
    df = df.withColumn("shares_traded", F.coalesce(F.abs(F.col("held") - F.lag("held").over(w)), F.lit(0.0)))
    return df.withColumn("transaction_cost", F.col("shares_traded") * s.commission + F.col("shares_traded") * F.col("close") * F.col("slippage")).drop("held", "median_atr")


def returns(df: DataFrame) -> DataFrame:
    """Adds ret_net, the equity curve cum_returns, its peak and the drawdown."""
    w = series.ordered(["symbol"], ["us"])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    change = series.safe_div(F.col("close"), F.lag("close").over(w)) - 1
    cost = F.coalesce(series.safe_div(F.col("transaction_cost"), F.lag("close").over(w)), F.lit(0.0))
    df = df.withColumn("ret_net", F.lag("position").over(w) * change - cost)
    factor = 1 + F.coalesce(F.col("ret_net"), F.lit(0.0))
    # a product as a sum of logarithms; a factor of zero or less ends the curve at zero
    df = df.withColumns({"_log": F.sum(F.when(factor > 0, F.ln(factor)).otherwise(0.0)).over(so_far), "_ruined": F.max(F.when(factor <= 0, 1).otherwise(0)).over(so_far)})
    df = df.withColumn("cum_returns", F.when(F.col("_ruined") == 1, 0.0).otherwise(F.exp("_log"))).drop("_log", "_ruined")
    df = df.withColumn("peak", F.max("cum_returns").over(so_far))
    return df.withColumn("drawdown", series.safe_div(F.col("cum_returns") - F.col("peak"), F.col("peak")))


def rolling_sharpe(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Adds rolling_sharpe: the whole series' annualised mean return over the rolling annualised deviation, missing returns counted as 0.

    The window is ``rows``, or a fifth of the series' rows, at most 390 and at least 10; it is null in series no longer than it."""
    counts = df.groupBy("symbol").agg(F.count("*").alias("_n"), F.avg(F.coalesce("ret_net", F.lit(0.0))).alias("_mean"))
    size = F.lit(rows) if rows else F.greatest(F.least(F.floor(F.col("_n") / 5), F.lit(390)), F.lit(10))
    df = df.withColumns({"_r0": F.coalesce("ret_net", F.lit(0.0)), "_one": F.lit(1)}).join(counts.withColumn("_size", size.cast("long")), "symbol")
    df = series.running(df, ["symbol"], ["us"], "us", CHUNK, {"_row": ("sum", "_one")})
    df = series.trailing_of(df, ["symbol"], "_row", 20_000, "_size", rows or 390, {"_sd": ("stddev_samp", "_r0")})
    sd = F.when((F.col("_n") > F.col("_size")) & (F.col("_row") >= F.col("_size")), F.col("_sd"))
    value = series.safe_div(F.col("_mean") * YEAR_OF_MINUTES, sd * YEAR_OF_MINUTES**0.5)
    return df.withColumn("rolling_sharpe", value).drop("_r0", "_one", "_row", "_sd", "_n", "_mean", "_size")


def benchmark(df: DataFrame) -> DataFrame:
    """Adds benchmark: the growth of one unit held from the first bar on."""
    first = F.first("close").over(Window.partitionBy("symbol").orderBy("us").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("benchmark", series.safe_div(F.col("close"), first))  # the product of all changes


def cumulative_trades(closed: DataFrame) -> DataFrame:
    """Trades with cum_pnl, the sum of pnl_pct so far in per cent, and the sum before each one (before), 0 for the first."""
    w = series.ordered(["symbol"], ["trade_id"])
    total = F.sum(F.col("pnl_pct") * 100).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return closed.withColumn("cum_pnl", total).withColumn("before", F.coalesce(F.lag("cum_pnl").over(w), F.lit(0.0)))


def win_loss(closed: DataFrame) -> DataFrame:
    """Wins and losses (trades without a gain) by symbol: counts, shares, and the greatest and least result."""
    p = F.col("pnl_pct")
    out = closed.groupBy("symbol").agg(F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"), F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"))
    n = F.col("wins") + F.col("losses")
    return out.withColumns({"win_share": F.col("wins") / n, "loss_share": F.col("losses") / n})


def performance(df: DataFrame, closed: DataFrame, compat_years: bool = False) -> DataFrame:
    """The 16 figures of each symbol's equity curve and trades. cagr and turnover are null for less than a day, unless
    ``compat_years`` takes a billionth of a year then."""
    r = F.col("ret_net")
    days = F.floor((F.max("us") - F.min("us")) / 86_400_000_000)
    rows = df.groupBy("symbol").agg(
        days.alias("days"), F.max(F.struct("us", "cum_returns")).alias("end"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.stddev_samp(F.when(r < 0, r)).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.sum(F.abs("position_change")).alias("moved"))
    p = F.col("pnl_pct")
    of = closed.groupBy("symbol").agg(
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(p).alias("avg_profit"), F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("avg_loss"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("won"), F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("lost"), F.count("*").alias("num_trades"),
        F.avg((F.col("exit_reason") == "stop_loss").cast("double")).alias("stop_loss_rate"), F.avg((F.col("exit_reason") == "take_profit").cast("double")).alias("take_profit_rate"), F.avg("duration_minutes").alias("avg_duration"))
    years = F.when(F.col("days") > 0, F.col("days") / 365.25)
    years = F.coalesce(years, F.lit(1e-9)) if compat_years else years
    gain = F.col("end.cum_returns") - 1
    ratio = lambda b: F.coalesce(series.safe_div(F.col("mean"), F.col(b)) * YEAR_OF_MINUTES**0.5, F.lit(0.0))
    out = rows.join(of, "symbol", "left").withColumns({"total_return": gain, "cagr": F.when(gain > -1, F.pow(1 + gain, 1 / years) - 1).otherwise(-1.0), "sharpe": ratio("sd"), "sortino": ratio("down"), "turnover": F.col("moved") / 2 / years})
    zero = ("hit_rate", "avg_profit", "avg_win", "avg_loss", "num_trades", "stop_loss_rate", "take_profit_rate", "avg_duration")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {
        "profit_factor": F.when(F.col("lost").isNull(), 0.0).when(F.col("lost") > 0, F.col("won") / F.when(F.col("lost") > 0, F.col("lost"))).otherwise(F.lit(float("inf"))),
        "calmar": F.coalesce(series.safe_div(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0))})
    return out.select("symbol", "total_return", "cagr", "sharpe", "sortino", "calmar", "max_drawdown", *zero[:4], "profit_factor", "turnover", *zero[4:])


def signal_changes(df: DataFrame) -> DataFrame:
    """Entries and exits of final_signal by symbol."""
    w = series.ordered(["symbol"], ["us"])
    change = df.withColumn("_d", F.col("final_signal") - F.lag("final_signal").over(w))
    return change.groupBy("symbol").agg(F.count_if(F.col("_d") > 0).alias("entries"), F.count_if(F.col("_d") < 0).alias("exits"))
