"""Bar indicators and the entry and exit signals of a mean-reversion strategy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series

YEAR_OF_MINUTES = 252 * 390


@dataclass(frozen=True)
class Settings:
    """Parameters of indicators, signals, positions and costs."""

    ma_rows: int = 20
    z_entry: float = 1.0
    z_exit: float = 0.0
    rsi_rows: int = 14
    rsi_entry: float = 45.0
    rsi_exit: float = 65.0
    atr_rows: int = 14
    stop_loss: float = 1.5
    take_profit: float = 2.0
    risk: float = 0.01
    max_position: float = 0.1
    vwap_entry: float = 0.001
    adx_rows: int = 14
    adx_limit: float = 25.0
    min_volatility: float = 0.0
    max_volatility: float = 1e9
    min_hold: int = 5
    cooldown: int = 15
    delay: int = 1
    slippage: float = 0.0001
    commission: float = 0.0005
    strict_filters: bool = False
    #: RSI read as 0, as an index mismatch once made it.
    compat_rsi: bool = False


def indicators(bars: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bars (symbol, us, open, high, low, close, volume) with averages, z-score, RSI, session VWAP, ATR, ADX and volatility.

    All windows share one partitioning and order, so the plan sorts each symbol once."""
    w = series.ordered(["symbol"], ["us"])
    previous = F.lag("close").over(w)
    day = F.floor(F.col("us") / 86_400_000_000).cast("long")
    minute = (F.floor(F.col("us") / 60_000_000) % 1440).cast("int")
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = bars.withColumns({"day": day, "delta": F.col("close") - previous, "ret_min": series.safe_div(F.col("close"), previous) - 1, "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)), "up": up, "down": down})
    plus = F.when((F.col("up") <= 0) | (F.col("up") < F.col("down")), 0.0).otherwise(F.col("up"))
    df = df.withColumns({"gain": F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0), "loss": F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0), "plus_dm": plus})
    df = df.withColumn("minus_dm", F.when((F.col("down") <= 0) | (F.col("down") < F.col("plus_dm")), 0.0).otherwise(F.col("down")))
    session = Window.partitionBy("symbol", "day").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    value, volume = F.sum(F.col("close") * F.col("volume")).over(session), F.sum("volume").over(session)
    df = df.withColumns({
        "ma": series.rolling(F.avg, "close", w, s.ma_rows, 1), "sd": series.rolling(F.stddev_samp, "close", w, s.ma_rows, 1), "avg_gain": series.rolling(F.avg, "gain", w, s.rsi_rows, 1),
        "avg_loss": series.rolling(F.avg, "loss", w, s.rsi_rows, 1), "vwap": value / series.guarded(volume), "atr": series.rolling(F.avg, "tr", w, s.atr_rows, 1),
        "plus_sum": series.rolling(F.sum, "plus_dm", w, s.adx_rows), "minus_sum": series.rolling(F.sum, "minus_dm", w, s.adx_rows), "vol_5": series.rolling(F.stddev_samp, "ret_min", w, 5) * YEAR_OF_MINUTES**0.5,
    })
    strength = F.col("avg_gain") / series.guarded(F.col("avg_loss"))
    smooth = series.guarded(F.col("atr") * s.adx_rows)
    df = df.withColumns({
        "z_score": F.coalesce(series.safe_div(F.col("close") - F.col("ma"), F.col("sd")), F.lit(0.0)), "rsi": F.lit(0.0) if s.compat_rsi else 100 - 100 / (1 + strength),
        "plus_di": 100 * F.col("plus_sum") / smooth, "minus_di": 100 * F.col("minus_sum") / smooth,
    })
    df = df.withColumn("dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / series.guarded(F.col("plus_di") + F.col("minus_di")))
    df = df.withColumn("adx", series.rolling(F.avg, "dx", w, s.adx_rows))
    df = df.withColumns({c: series.filled(c, w) for c in ("ma", "sd", "z_score", "rsi", "vwap", "atr", "adx")})
    avoid = ((minute >= 540) & (minute < 585)) | ((minute >= 945) & (minute < 960))
    return df.withColumn("avoid_time", avoid).drop("delta", "up", "down", "gain", "loss", "avg_gain", "avg_loss", "plus_sum", "minus_sum", "tr")


def signals(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds signal_raw and signal (delayed by ``delay`` bars)."""
    enter = (F.col("z_score") < -s.z_entry) & ((F.col("rsi") < s.rsi_entry) | (F.col("close") < F.col("vwap") * (1 - s.vwap_entry))) & ~F.col("avoid_time")
    if s.strict_filters:
        enter &= (F.col("adx") < s.adx_limit) & F.coalesce((F.col("vol_5") > s.min_volatility) & (F.col("vol_5") < s.max_volatility), F.lit(False))
    leave = (F.col("z_score") > s.z_exit) | (F.col("rsi") > s.rsi_exit)
    raw = F.when(leave, 0).when(enter, 1).otherwise(0)
    w = series.ordered(["symbol"], ["us"])
    return df.withColumn("signal_raw", raw).withColumn("signal", F.coalesce(F.lag("signal_raw", s.delay).over(w), F.lit(0)))
