"""Queries over the tick view of the tables, with the same results in SQL.

Bars are one hour, the tick windows hours rather than seconds, since the tables' ticks are sparse.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators import asof, backtest, book, candles, chains, cointegration, crossing, features, indicators, learning, paths, research, rules
from tidemark.sources import market
from tidemark.sources.shared import shared_folder, stored
from tidemark.streaming import online
from tidemark.streaming import rules as stream_rules
from tidemark.streaming import streams

HOUR = 3600
US = 1_000_000
SETTINGS = indicators.Settings(z_entry=0.5, rsi_entry=55.0, min_hold=3, cooldown=4)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TICKS = """ticks as (
  select event_type as symbol, epoch_us(ts) as us, value as price, cast(regexp_extract(props, '([0-9]+)', 1) as double) + 1 as quantity,
         event_id as trade_id, user_id % 2 = 1 as is_buyer_maker from events)"""


def bars_sql(seconds: int = HOUR, name: str = "bars") -> str:
    step = seconds * US
    return f"""{name} as (
  select symbol, (us // {step}) * {step} as bucket, arg_min(price, (us, trade_id)) as open, max(price) as high, min(price) as low,
         arg_max(price, (us, trade_id)) as close, sum(quantity) as volume, count(*) as tick_count, min(us) as open_us, max(us) as close_us
  from ticks group by 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums agree."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, digits: int = 6):
    """Registers a function of (spark, folder) under its name, with doubles rounded, and SQL of the same result."""

    def register(function):
        QUERIES[function.__name__] = lambda spark, folder: rounded(function(spark, folder), digits)
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return candles.candles(market.ticks(spark, folder), HOUR)


def as_bars(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.col("bucket"))


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


@query(f"with {TICKS}, {bars_sql()} select symbol, bucket, open_us, close_us, {r('open', 'high', 'low', 'close', 'volume')}, tick_count from bars")
def candles_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return bars(spark, folder)


QUERIES["candles"] = QUERIES["candles_hourly"]
ORACLE_SQL["candles"] = ORACLE_SQL["candles_hourly"]
del QUERIES["candles_hourly"], ORACLE_SQL["candles_hourly"]


@query(f"""with {TICKS}, {bars_sql()}
select count(*) as n_candles, sum(tick_count) as ticks, round(sum(volume), 6) as volume, round(min(low), 6) as low, round(max(high), 6) as high,
       bool_and(high >= greatest(low, open, close) and low <= least(open, close) and tick_count > 0 and volume >= 0) as all_valid from bars""")
def candle_totals(spark: SparkSession, folder: str) -> DataFrame:
    return candles.totals(bars(spark, folder))


@query(f"with {TICKS}, {bars_sql()} select symbol, bucket, {r('close')} from bars qualify row_number() over (partition by symbol order by bucket desc) <= 80")
def last_candles(spark: SparkSession, folder: str) -> DataFrame:
    return candles.last_candles(bars(spark, folder)).select("symbol", "bucket", "close")


@query(f"with {TICKS} select symbol, (us // {HOUR * US}) * {HOUR * US} as bucket, round(avg(price), 6) as mid_price from ticks group by 1, 2")
def resample_mean(spark: SparkSession, folder: str) -> DataFrame:
    return candles.resampled_mean(market.ticks(spark, folder), HOUR)


@query(f"""with {TICKS} select symbol, (us // {HOUR * US}) * {HOUR * US} as bucket, us, {r('price')}, trade_id from ticks
qualify row_number() over (partition by symbol, us // {HOUR * US} order by us, trade_id) = 1""")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return candles.first_per_time(market.ticks(spark, folder), HOUR).select("symbol", "bucket", "us", "price", "trade_id")


@query("select event_type, round(avg(value), 6) as mean_value, count(*) as n from events group by 1")
def group_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    return candles.by_reason(market.table(spark, folder, "events"), "event_type", "value")


@query(f"""with {TICKS}, found as (select (us // {HOUR * US}) % 24 as h, avg(price) as m, count(*) as n from ticks group by 1)
select cast(range as int) as hour, round(m, 6) as mean_value, coalesce(n, 0) as n from range(24) left join found on h = range""")
def hours_dense(spark: SparkSession, folder: str) -> DataFrame:
    return candles.by_hour(market.ticks(spark, folder), "us", "price")


@query(f"""with {TICKS} select symbol, count(price) as n, round(sum(price), 4) as total, round(avg(price), 4) as mean, round(stddev_samp(price), 4) as sd, round(stddev_pop(price), 4) as sd_pop,
round(var_samp(price), 4) as variance, round(min(price), 4) as low, round(max(price), 4) as high, round(median(price), 4) as median, round(avg(price) filter (price > 0), 4) as mean_positive,
round(coalesce(sum(price) filter (price < 0), 0), 4) as sum_negative from ticks group by 1""", digits=4)
def summary_stats(spark: SparkSession, folder: str) -> DataFrame:
    return candles.summary(market.ticks(spark, folder), "price", ["symbol"])


@query(f"""with {TICKS}, span as (select min(price) as lo, max(price) as hi from ticks)
select cast(least(floor((price - lo) / ((hi - lo) / 15)), 14) as int) as bin, count(*) as n, round(min(lo), 6) as range_low, round(max(hi), 6) as range_high from ticks, span group by 1""")
def histogram_prices(spark: SparkSession, folder: str) -> DataFrame:
    return candles.histogram(market.ticks(spark, folder), "price", 15)


@query(f"""with {TICKS} select symbol, count(*) as n, round(avg(price), 6) as mean, round(stddev_samp(price), 6) as sd from ticks group by 1""")
def merged_statistics(spark: SparkSession, folder: str) -> DataFrame:
    t = market.ticks(spark, folder)
    of = lambda part: t.where(part).groupBy("symbol").agg(F.count("price").alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"))
    return candles.merged_stats(of(F.col("trade_id") % 3 == 0), of(F.col("trade_id") % 3 != 0), ["symbol"])


@query(f"""with {TICKS} select strftime(make_timestamp(us), '%Y%m%d_%H') as hour, min(us) as first_time, max(us) as last_time, count(*) as n_rows from ticks group by 1""")
def partition_ranges(spark: SparkSession, folder: str) -> DataFrame:
    zoned = market.ticks(spark, folder).withColumn("hour", F.date_format(F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000)"), "yyyyMMdd_HH"))
    return market.hour_ranges(zoned, "us")


@query(f"""with {TICKS}, lim as (select min(us) // {HOUR * US} as a, max(us) // {HOUR * US} as b from ticks)
select range as grid_idx, (a + range) * {HOUR * US} as us, (a + range - 1) * {HOUR * US} as prev_us from lim, range((select b - a + 1 from lim))""")
def time_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = market.time_grid(market.ticks(spark, folder), "ts", HOUR)
    return grid.select("grid_idx", F.unix_micros("timestamp").alias("us"), F.unix_micros("prev_timestamp").alias("prev_us"))


IND = f"""with {TICKS}, {bars_sql()},
a as (select *, bucket as us, close - lag(close) over w as delta, close / lag(close) over w - 1 as ret_min,
  greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr, high - lag(high) over w as up, lag(low) over w - low as down,
  bucket // 86400000000 as day, (bucket // 60000000) % 1440 as minute from bars window w as (partition by symbol order by bucket)),
b as (select *, case when delta > 0 then delta else 0 end as gain, case when delta < 0 then -delta else 0 end as loss, case when up <= 0 or up < down then 0 else up end as plus_dm from a),
c as (select *, case when down <= 0 or down < plus_dm then 0 else down end as minus_dm from b),
d as (select *, avg(close) over w20 as ma, stddev_samp(close) over w20 as sd, avg(gain) over w14 as avg_gain, avg(loss) over w14 as avg_loss,
  sum(close * volume) over s / (case when sum(volume) over s = 0 then 1e-10 else sum(volume) over s end) as vwap, avg(tr) over w14 as atr,
  case when count(plus_dm) over w14 >= 14 then sum(plus_dm) over w14 end as plus_sum, case when count(minus_dm) over w14 >= 14 then sum(minus_dm) over w14 end as minus_sum,
  case when count(ret_min) over w5 >= 5 then stddev_samp(ret_min) over w5 end * sqrt(98280) as vol_5 from c
  window w20 as (partition by symbol order by us rows 19 preceding), w14 as (partition by symbol order by us rows 13 preceding), w5 as (partition by symbol order by us rows 4 preceding),
  s as (partition by symbol, day order by us rows unbounded preceding)),
e as (select *, coalesce((close - ma) / nullif(sd, 0), 0) as z_score, 100 - 100 / (1 + avg_gain / (case when avg_loss = 0 then 1e-10 else avg_loss end)) as rsi,
  100 * plus_sum / (case when atr * 14 = 0 then 1e-10 else atr * 14 end) as plus_di, 100 * minus_sum / (case when atr * 14 = 0 then 1e-10 else atr * 14 end) as minus_di from d),
f as (select *, 100 * abs(plus_di - minus_di) / (case when plus_di + minus_di = 0 then 1e-10 else plus_di + minus_di end) as dx from e),
g as (select *, case when count(dx) over w14 >= 14 then avg(dx) over w14 end as adx0 from f window w14 as (partition by symbol order by us rows 13 preceding)),
ind as (select * exclude (sd, adx0), coalesce(last_value(sd ignore nulls) over p, first_value(sd ignore nulls) over n, 0) as sd, coalesce(last_value(adx0 ignore nulls) over p, first_value(adx0 ignore nulls) over n, 0) as adx,
  (minute >= 540 and minute < 585) or (minute >= 945 and minute < 960) as avoid_time from g
  window p as (partition by symbol order by us rows between unbounded preceding and current row), n as (partition by symbol order by us rows between current row and unbounded following))"""


@query(f"{IND} select symbol, us, {r('ma', 'sd', 'z_score', 'rsi', 'vwap', 'atr', 'adx', 'vol_5', 'plus_di', 'minus_di', digits=8)}, avoid_time from ind", digits=8)
def indicator_table(spark: SparkSession, folder: str) -> DataFrame:
    return indicators.indicators(as_bars(bars(spark, folder)), SETTINGS).select("symbol", "us", "ma", "sd", "z_score", "rsi", "vwap", "atr", "adx", "vol_5", "plus_di", "minus_di", "avoid_time")


SIGNALS = IND + f""",
raw as (select *, case when z_score > 0 or rsi > 65 then 0 when z_score < -{SETTINGS.z_entry} and (rsi < {SETTINGS.rsi_entry} or close < vwap * (1 - 0.001)) and not avoid_time then 1 else 0 end as signal_raw from ind),
sig as (select *, coalesce(lag(signal_raw, 1) over (partition by symbol order by us), 0) as signal, row_number() over (partition by symbol order by us) - 1 as i from raw)"""


@query(f"{SIGNALS} select symbol, us, signal_raw, signal from sig")
def signal_table(spark: SparkSession, folder: str) -> DataFrame:
    return signalled(spark, folder).select("symbol", "us", "signal_raw", "signal")


def signalled(spark: SparkSession, folder: str) -> DataFrame:
    return indicators.signals(indicators.indicators(as_bars(bars(spark, folder)), SETTINGS), SETTINGS)


#: The position machine as a recursion over the bars of each symbol.
POSITIONS = SIGNALS.replace("with ", "with recursive ", 1) + f""",
step as (
  select symbol, i, us, close, atr, 0 as pos, cast(null as double) as entry, cast(null as double) as stop, cast(null as double) as target, 0 as trade, -{SETTINGS.cooldown} as last_exit, -{SETTINGS.cooldown} as entered, '' as reason
  from sig where i = 0 and not (signal = 1)
  union all
  select symbol, i, us, close, atr, case when was_open then (case when leaves then 0 else 1 end) when enters then 1 else 0 end,
    case when was_open then entry when enters then close end, case when was_open then stop when enters then close - 1.5 * atr end, case when was_open then target when enters then close + 2 * atr end,
    case when enters then trade + 1 else trade end, case when leaves then i else last_exit end, case when enters then i else entered end, case when leaves then why else '' end
  from (select s.symbol, s.i, s.us, s.close, s.atr, p.entry, p.stop, p.target, p.trade, p.last_exit, p.entered, p.pos = 1 as was_open,
      p.pos = 0 and s.signal = 1 and s.i - p.last_exit >= {SETTINGS.cooldown} as enters,
      case when s.low <= p.stop then 'stop_loss' when s.high >= p.target then 'take_profit' when s.signal = 0 then 'signal' when s.z_score > 0 or s.rsi > 65 then 'indicator_exit' end as why,
      p.pos = 1 and s.i - p.entered >= {SETTINGS.min_hold} and (s.low <= p.stop or s.high >= p.target or s.signal = 0 or s.z_score > 0 or s.rsi > 65) as leaves
    from step p join sig s on s.symbol = p.symbol and s.i = p.i + 1)),
pos as (select *, case when pos = 1 or reason <> '' then trade else 0 end as trade_id from step)"""


def positioned(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.positions(signalled(spark, folder), SETTINGS)


@query(f"{POSITIONS} select symbol, us, pos as final_signal, trade_id, reason as exit_reason from pos")
def position_machine(spark: SparkSession, folder: str) -> DataFrame:
    return positioned(spark, folder).select("symbol", "us", "final_signal", "trade_id", "exit_reason")


TRADES = POSITIONS + """,
tr as (select symbol, trade_id, min(us) as entry_us, min(entry) as entry_price, min(us) filter (reason <> '') as exit_us, min(close) filter (reason <> '') as exit_price, min(reason) filter (reason <> '') as exit_reason
  from pos where trade_id > 0 group by 1, 2)"""


@query(f"""{TRADES} select symbol, trade_id, entry_us, exit_us, {r('entry_price', 'exit_price')}, round(exit_price / entry_price - 1, 6) as pnl_pct, round((exit_us - entry_us) / 60000000, 6) as duration_minutes, exit_reason
from tr where exit_us is not null""")
def trade_table(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.trades(positioned(spark, folder))


SIZED = TRADES + f""",
sz as (select p.symbol, p.us, p.close, p.atr, coalesce(p.pos * least({SETTINGS.risk} / (f.atr0 * 1.5), {SETTINGS.max_position} / f.entry0) * p.close, 0) as position
  from pos p left join (select symbol, trade_id, arg_min(case when atr = 0 then 1e-10 else atr end, us) as atr0, arg_min(entry, us) as entry0 from pos where trade_id > 0 group by 1, 2) f on f.symbol = p.symbol and f.trade_id = p.trade_id),
sc as (select *, coalesce(position - lag(position) over (partition by symbol order by us), 0) as position_change,
  {SETTINGS.slippage} * (1 + atr / (select median(atr) from sz m where m.symbol = sz.symbol)) as slippage from sz),
ex as (select *, close * (1 + sign(position_change) * slippage) as executed_price, abs(coalesce(position / close - lag(position / close) over (partition by symbol order by us), 0)) as shares_traded from sc),
co as (select *, shares_traded * {SETTINGS.commission} + shares_traded * close * slippage as transaction_cost from ex),
rt as (select *, lag(position) over w * (close / lag(close) over w - 1) - coalesce(transaction_cost / lag(close) over w, 0) as ret_net from co window w as (partition by symbol order by us)),
cu as (select *, exp(sum(ln(1 + coalesce(ret_net, 0))) over (partition by symbol order by us rows unbounded preceding)) as cum_returns from rt),
dd as (select *, max(cum_returns) over (partition by symbol order by us rows unbounded preceding) as peak from cu),
eq as (select *, (cum_returns - peak) / peak as drawdown from dd)"""


def equity(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.returns(backtest.costed(backtest.sized(positioned(spark, folder), SETTINGS), SETTINGS))


@query(f"{SIZED} select symbol, us, {r('position', 'position_change', 'executed_price', 'shares_traded', 'transaction_cost', 'ret_net', 'cum_returns', 'drawdown')} from eq")
def equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    return equity(spark, folder).select("symbol", "us", "position", "position_change", "executed_price", "shares_traded", "transaction_cost", "ret_net", "cum_returns", "drawdown")


@query(f"""{SIZED}, closed as (select *, exit_price / entry_price - 1 as pnl from tr where exit_us is not null),
of_trades as (select symbol, avg(case when pnl > 0 then 1.0 else 0.0 end) as hit_rate, avg(pnl) as avg_profit, coalesce(avg(pnl) filter (pnl > 0), 0) as avg_win, coalesce(avg(pnl) filter (pnl < 0), 0) as avg_loss,
  coalesce(sum(pnl) filter (pnl > 0), 0) as won, -coalesce(sum(pnl) filter (pnl < 0), 0) as lost, count(*) as num_trades, avg(case when exit_reason = 'stop_loss' then 1.0 else 0 end) as stop_loss_rate,
  avg(case when exit_reason = 'take_profit' then 1.0 else 0 end) as take_profit_rate, avg((exit_us - entry_us) / 60000000) as avg_duration from closed group by 1),
of_rows as (select symbol, (max(us) - min(us)) // 86400000000 / 365.25 as years, arg_max(cum_returns, us) - 1 as total_return, avg(ret_net) as m, stddev_samp(ret_net) as sd, stddev_samp(ret_net) filter (ret_net < 0) as down,
  min(drawdown) as max_drawdown, sum(abs(position_change)) as moved from eq group by 1)
select symbol, round(total_return, 6) as total_return, round(pow(1 + total_return, 1 / years) - 1, 6) as cagr, round(coalesce((pow(1 + total_return, 1 / years) - 1) / nullif(abs(max_drawdown), 0), 0), 4) as calmar, round(coalesce(m / nullif(sd, 0) * sqrt(98280), 0), 4) as sharpe, round(coalesce(m / nullif(down, 0) * sqrt(98280), 0), 4) as sortino,
  round(max_drawdown, 6) as max_drawdown, round(hit_rate, 6) as hit_rate, round(avg_profit, 6) as avg_profit, round(avg_win, 6) as avg_win, round(avg_loss, 6) as avg_loss, round(won / lost, 4) as profit_factor,
  round(moved / 2 / years, 4) as turnover, num_trades, round(stop_loss_rate, 6) as stop_loss_rate, round(take_profit_rate, 6) as take_profit_rate, round(avg_duration, 4) as avg_duration
from of_rows join of_trades using (symbol)""", digits=12)
def performance_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = equity(spark, folder)
    out = backtest.performance(rows, backtest.trades(rows))
    four = ("calmar", "sharpe", "sortino", "profit_factor", "turnover", "avg_duration")
    return out.select(*(F.round(c, 4 if c in four else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


FEATURES = f"""with {TICKS}, once as (select * from ticks qualify row_number() over (partition by symbol, us order by trade_id) = 1),
pr as (select *, price / nullif(lag(price) over (partition by symbol order by us), 0) - 1 as ret, case when not is_buyer_maker then quantity else 0 end as buy, case when is_buyer_maker then quantity else 0 end as sell from once),
wi as (select *, sum(buy) over w1 as b1, sum(sell) over w1 as s1, sum(buy) over w6 as b6, sum(sell) over w6 as s6, count(price) over w1 as n1, stddev_samp(ret) over w12 as sd12, stddev_samp(ret) over w120 as sd120 from pr
  window w1 as (partition by symbol order by us range {HOUR * US - 1} preceding), w6 as (partition by symbol order by us range {6 * HOUR * US - 1} preceding),
  w12 as (partition by symbol order by us range {12 * HOUR * US - 1} preceding), w120 as (partition by symbol order by us range {120 * HOUR * US - 1} preceding)),
pv as (select symbol, us, price, (us // {HOUR * US}) * {HOUR * US} as bucket, (b1 - s1) / (b1 + s1 + 1e-9) as tfi, (b6 - s6) / (b6 + s6 + 1e-9) as obi, n1 / {HOUR} as ar, sd12 / (sd120 + 1e-9) as vc from wi),
gr as (select symbol, bucket, avg(price) as mid_price, arg_max(struct_pack(tfi, obi, ar, vc), us) as e, arg_max(struct_pack(tfi, obi, ar, vc), us) filter (us = bucket) as a from pv group by 1, 2),
g2 as (select symbol, bucket, mid_price, coalesce(a, lag(e) over (partition by symbol order by bucket)) as v from gr),
g3 as (select symbol, bucket, mid_price, v.tfi as tfi, v.obi as obi, v.ar as ar, v.vc as vc, mid_price / nullif(lag(mid_price) over (partition by symbol order by bucket), 0) - 1 as ret from g2),
g4 as (select *, case when count(vc) over w12 >= 12 then stddev_samp(vc) over w12 end as vov, case when count(obi) over w12 >= 12 then avg(obi) over w12 end as om,
  {", ".join(f"mid_price / nullif(lag(mid_price, {p}) over w, 0) - 1 as m{p}, case when count(ret) over (partition by symbol order by bucket rows {p - 1} preceding) >= {p} then stddev_samp(ret) over (partition by symbol order by bucket rows {p - 1} preceding) end as v{p}" for p in features.PERIODS)}
  from g3 window w as (partition by symbol order by bucket), w12 as (partition by symbol order by bucket rows 11 preceding))
select symbol, bucket, {", ".join(f"round(coalesce({e}, 0), 8) as {n}" for e, n in [("mid_price", "mid_price"), ("tfi", "feature_tfi"), ("obi", "feature_obi"), ("ar", "feature_arrival_rate"), ("vc", "feature_volatility_cluster"), ("vov", "feature_vol_of_vol_1m"), ("om / nullif(lag(om, 12) over w, 0) - 1", "feature_obi_accel"), *((f"{k[0]}{p}", f"feature_{k}_{p}") for p in features.PERIODS for k in ("momentum", "volatility")), ("m60 / nullif(lag(m60, 12) over w, 0) - 1", "feature_momentum_60_acceleration"), ("m120 / nullif(lag(m120, 12) over w, 0) - 1", "feature_momentum_120_acceleration"), ("obi * vc", "feature_vol_weighted_obi"), ("ar * tfi", "feature_arrival_weighted_tfi")])}
from g4 window w as (partition by symbol order by bucket)"""


@query(FEATURES, digits=8)
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_matrix(market.ticks(spark, folder), HOUR, obi=6 * HOUR, short=12 * HOUR, long=120 * HOUR)


def _grid_sql(sample: bool, back: int) -> str:
    sd = "stddev_samp" if sample else "stddev_pop"
    return f"""with {TICKS}, t as (select *, case when not is_buyer_maker then quantity else 0 end as buy, case when is_buyer_maker then quantity else 0 end as sell,
  case when price > lag(price) over w then 1 else 0 end as up, case when price < lag(price) over w then 1 else 0 end as down from ticks window w as (partition by symbol order by us, trade_id)),
u as (select *, sum(up) over w as ups, sum(down) over w as downs, count(*) over w as back from t window w as (partition by symbol order by us, trade_id rows {back} preceding)),
g as (select symbol, unnest(range((min(us) // {HOUR * US}) * {HOUR * US}, max(us) + 1, {HOUR * US})) as bucket from ticks group by symbol),
j as (select g.symbol, g.bucket, sum(buy) filter (us > bucket - {6 * HOUR * US}) as wb, sum(sell) filter (us > bucket - {6 * HOUR * US}) as ws, sum(buy) filter (us > bucket - {HOUR * US}) as b, sum(sell) filter (us > bucket - {HOUR * US}) as s,
    count(price) filter (us > bucket - {HOUR * US}) as n, max(price) filter (us > bucket - {HOUR * US}) - min(price) filter (us > bucket - {HOUR * US}) as sp, case when count(price) > 1 then {sd}(price) else 0 end as sd
  from g left join t on t.symbol = g.symbol and t.us > g.bucket - {12 * HOUR * US} and t.us <= g.bucket group by 1, 2),
k as (select j.*, ups, downs from j asof left join (select symbol, us, case when back > {int(sample)} then ups end as ups, downs from u) v on v.symbol = j.symbol and v.us <= j.bucket)
select symbol, bucket, round(coalesce((wb - ws) / nullif(wb + ws, 0), 0), 6) as order_book_imbalance, round(coalesce((b - s) / nullif(b + s, 0), 0), 6) as trade_flow_imbalance,
  round(case when avg(sd) over w > 0 then sd / avg(sd) over w else 1 end, 6) as volatility_cluster, round(case when n > 1 then sp else 0 end, 6) as spread_proxy, round(n / {HOUR}, 6) as trade_arrival_rate,
  round(coalesce((ups - downs) / nullif(ups + downs, 0), 0), 6) as tick_imbalance
from k window w as (partition by symbol order by bucket rows 11 preceding)"""


#: The tables' ticks are sparse, so the spans are hours.
GRID = {"near": 6 * HOUR, "spread": 12 * HOUR}


@query(_grid_sql(False, 19))
def grid_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.grid_features(market.ticks(spark, folder), HOUR, **GRID)


@query(_grid_sql(True, 20))
def grid_features_sample(spark: SparkSession, folder: str) -> DataFrame:
    return features.grid_features(market.ticks(spark, folder), HOUR, sample=True, **GRID)


@query(f"""with {TICKS}, {bars_sql()},
l as (select b.symbol, b.bucket, b.close, (select arg_min(struct_pack(c.close, c.bucket), (abs(c.bucket - b.bucket - {3 * HOUR * US}), c.bucket)) from bars c where c.symbol = b.symbol) as f from bars b)
select symbol, bucket, round(close, 6) as close, round(f.close, 6) as future_price, f.bucket as future_at, round(f.close / close - 1, 6) as return_pct, cast(f.close / close - 1 > 0 as int) as label from l""")
def asof_label(spark: SparkSession, folder: str) -> DataFrame:
    return asof.labelled(bars(spark, folder).select("symbol", "bucket", "close"), ["symbol"], "bucket", "close", 3 * HOUR * US)


@query(f"""with {TICKS}, g as (select symbol, bucket as us from (select symbol, (us // {HOUR * US}) * {HOUR * US} as bucket from ticks) group by 1, 2)
select symbol, g.us, round(price, 6) as last_price from g asof left join (select symbol, us, price from ticks) t using (symbol, us)""")
def asof_backward(spark: SparkSession, folder: str) -> DataFrame:
    t = market.ticks(spark, folder)
    grid = t.select("symbol", candles.bucket(F.col("us"), HOUR).alias("us")).distinct()
    return asof.backward(grid, t, ["symbol"], "us", "price", "trade_id", "last_price")


@query(f"""with {TICKS}, g as (select distinct symbol, (us // {HOUR * US}) * {HOUR * US} as us from ticks)
select g.symbol, g.us, count(t.price) as n, round(sum(t.quantity), 6) as volume, round(max(t.price), 6) as high from g left join ticks t on t.symbol = g.symbol and t.us > g.us - {6 * HOUR * US} and t.us <= g.us group by 1, 2""")
def interval_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    t = market.ticks(spark, folder).select("symbol", "us", "price", "quantity")
    grid = t.select("symbol", candles.bucket(F.col("us"), HOUR).alias("us")).distinct()
    return asof.over_interval(grid, t, ["symbol"], "us", {"n": ("count", "price", 6 * HOUR * US), "volume": ("sum", "quantity", 6 * HOUR * US), "high": ("max", "price", 6 * HOUR * US)})


@query(f"with {TICKS} select trade_id, symbol, round(sum(quantity) over (partition by symbol order by us, trade_id), 6) as total, round(max(price) over (partition by symbol order by us, trade_id), 6) as peak from ticks")
def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = series.running(market.ticks(spark, folder), ["symbol"], ["us", "trade_id"], "us", 24 * HOUR * US, {"total": ("sum", "quantity"), "peak": ("max", "price")})
    return out.select("trade_id", "symbol", "total", "peak")


LABELLED = f"""with {TICKS}, {bars_sql()},
sr as (select symbol, bucket, 0.5 + 0.02 * sin(bucket / {HOUR * US}.0) as score, lead(close) over (partition by symbol order by bucket) / close - 1 as return_pct from bars),
ok as (select *, cast(return_pct > 0 as int) as label from sr where return_pct is not null)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    w = series.ordered(["symbol"], ["bucket"])
    df = bars(spark, folder).select("symbol", "bucket", (0.5 + 0.02 * F.sin(F.col("bucket") / (HOUR * US))).alias("score"), (F.lead("close").over(w) / F.col("close") - 1).alias("return_pct"))
    return df.where("return_pct is not null").withColumn("label", (F.col("return_pct") > 0).cast("int"))


COST = 0.0005
THRESHOLDS = LABELLED + f""",
cand as (select range as k, round(0.51 - 0.001 * range, 3) as threshold from range(21)),
tried as (select k, threshold, 'long' as side, return_pct - {COST} as gain from ok, cand where score > threshold union all select k, threshold, 'short', -return_pct - {COST} from ok, cand where score < threshold),
tt as (select k, threshold, side, count(*) as n, avg(case when gain > 0 then 1.0 else 0 end) as win_rate, avg(gain) as mean_return, coalesce(avg(gain) / nullif(stddev_samp(gain), 0), 0) as sharpe,
  coalesce(coalesce(sum(gain) filter (gain > 0), 0) / nullif(-sum(gain) filter (gain < 0), 0), 0) as profit_factor from tried group by 1, 2, 3),
th as (select *, 0.4 * mean_return + 0.4 * sharpe + 0.2 * profit_factor as score from tt)"""


@query(f"{THRESHOLDS} select cast(k as int) as k, threshold, side, n, {r('win_rate', 'mean_return', 'sharpe', 'profit_factor', 'score')} from th")
def threshold_search(spark: SparkSession, folder: str) -> DataFrame:
    return learning.threshold_table(scores(spark, folder), cost=COST)


@query(f"""{THRESHOLDS} select side, case when max(score) > 0 then arg_max(threshold, (score, -k)) else (case side when 'long' then 0.55 else 0.45 end) end as threshold from th group by side""")
def threshold_choice(spark: SparkSession, folder: str) -> DataFrame:
    return learning.best_thresholds(learning.threshold_table(scores(spark, folder), cost=COST))


BACKTEST = LABELLED + """,
sg as (select *, cast(score >= 0.505 as int) as signal_long, cast(score <= 0.495 as int) as signal_short from ok),
pl as (select *, case when signal_long = 1 then return_pct - 0.001 else 0 end + case when signal_short = 1 then -return_pct - 0.001 else 0 end as pnl, signal_long = 1 and return_pct > 0.001 as cl, signal_short = 1 and return_pct < -0.001 as cs from sg),
cp as (select *, sum(pnl) over (partition by symbol order by bucket) as cum_pnl from pl),
bt as (select *, max(cum_pnl) over (partition by symbol order by bucket) - cum_pnl as drawdown from cp)"""


def backtested(spark: SparkSession, folder: str) -> DataFrame:
    return learning.signal_backtest(learning.with_signals(scores(spark, folder), 0.505, 0.495), ["symbol"], ["bucket"], 0.001)


@query(f"{BACKTEST} select symbol, bucket, signal_long, signal_short, {r('pnl', 'cum_pnl', 'drawdown')} from bt")
def signal_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return backtested(spark, folder).select("symbol", "bucket", "signal_long", "signal_short", "pnl", "cum_pnl", "drawdown")


@query(f"""{BACKTEST}, pairs as (select a.symbol, avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) as roc_auc from bt a join bt b on a.symbol = b.symbol and a.label = 1 and b.label = 0 group by 1),
m as (select symbol, sum(signal_long + signal_short) as total_trades, count(*) filter (cl) + count(*) filter (cs) as right_, avg(pnl) as avg_trade_return, coalesce(avg(pnl) filter (pnl > 0), 0) as avg_win, coalesce(avg(pnl) filter (pnl < 0), 0) as avg_loss,
  coalesce(sum(pnl) filter (pnl > 0), 0) as won, coalesce(-sum(pnl) filter (pnl < 0), 0) as lost, arg_max(cum_pnl, bucket) as final_pnl, max(drawdown) as max_drawdown, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 0) as sharpe,
  (max(bucket) - min(bucket)) / 86400000000 as days, coalesce(avg(label) filter (signal_long = 1), 0) as long_precision, coalesce(avg(1 - label) filter (signal_short = 1), 0) as short_precision from bt group by 1)
select symbol, cast(total_trades as bigint) as total_trades, round(right_ / total_trades, 6) as win_rate, {r("avg_trade_return", "avg_win", "avg_loss")}, case when lost > 0 then round(won / lost, 6) when won > 0 then 'inf'::double else 0 end as profit_factor,
  {r("final_pnl", "max_drawdown", "sharpe", "long_precision", "short_precision", "roc_auc")}, case when days > 0 and 1 + final_pnl >= 0 then round(ln(1 + final_pnl) * 365 / days, 6) end as log_annualised from m join pairs using (symbol)""")
def backtest_figures(spark: SparkSession, folder: str) -> DataFrame:
    """The annualised return is shown as its logarithm: over a few weeks the power is out of proportion."""
    out = learning.backtest_metrics(backtested(spark, folder), ["symbol"], "bucket", "label", "score")
    return out.withColumn("log_annualised", F.log1p("annualised_return")).drop("annualised_return")


@query(f"{LABELLED} select label, cast(score >= 0.5 as int) as predicted, count(*) as n from ok group by 1, 2")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return learning.confusion(scores(spark, folder).withColumn("p", (F.col("score") >= 0.5).cast("int")), "label", "p")


@query(f"""{LABELLED}, c as (select label, cast(score >= 0.5 as int) as p from ok), k as (select unnest([0, 1]) as class),
m as (select class, count(*) filter (label = class and p = class) as hit, count(*) filter (p = class) as called, count(*) filter (label = class) as support from c, k group by 1)
select class, round(coalesce(hit / nullif(called, 0), 0), 6) as precision, round(coalesce(hit / nullif(support, 0), 0), 6) as recall, round(coalesce(2 * (hit / called) * (hit / support) / nullif(hit / called + hit / support, 0), 0), 6) as f1, support from m""")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return learning.class_report(scores(spark, folder).withColumn("p", (F.col("score") >= 0.5).cast("int")), "label", "p")


@query(f"""{LABELLED}, s as (select round(score, 4) as s, sum(label) as pos, sum(1 - label) as neg from ok group by 1),
k as (select *, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp from s)
select round(sum((tp - pos / 2) * neg) / (sum(pos) * sum(neg)), 6) as roc_auc, round(sum(tp / (tp + fp) * pos) / sum(pos), 6) as average_precision,
  round(sum((tp / (tp + fp) + case when tp - pos + fp - neg > 0 then (tp - pos) / (tp - pos + fp - neg) else 1 end) / 2 * pos) / sum(pos), 6) as pr_auc, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from k""")
def roc_pr_auc(spark: SparkSession, folder: str) -> DataFrame:
    return learning.auc(scores(spark, folder).withColumn("score", F.round("score", 4)), "label", "score")


@query(f"""{LABELLED}, s as (select round(score, 4) as score, sum(label) as pos, sum(1 - label) as neg from ok group by 1), k as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from s)
select score, round(fp / (select sum(neg) from s), 6) as fpr, round(tp / (select sum(pos) from s), 6) as tpr, round(tp / (tp + fp), 6) as precision from k""")
def roc_pr_curves(spark: SparkSession, folder: str) -> DataFrame:
    return learning.curves(scores(spark, folder).withColumn("score", F.round("score", 4)), "label", "score")


@query("select sum(quality) as positives, sum(1 - quality) as negatives, round(sum(1 - quality) / greatest(sum(quality), 1), 6) as weight from labels")
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return learning.class_balance(market.table(spark, folder, "labels"), "quality")


@query(f"""with {TICKS}, {bars_sql()}, s as (select avg(close) as mc, stddev_samp(close) as sc, avg(volume) as mv, stddev_samp(volume) as sv from bars)
select symbol, bucket, round(least(greatest((close - mc) / (sc + 1e-8), -5), 5), 6) as close_norm, round(least(greatest((volume - mv) / (sv + 1e-8), -5), 5), 6) as volume_norm from bars, s""")
def normalised_bars(spark: SparkSession, folder: str) -> DataFrame:
    return features.normalised(bars(spark, folder), ["close", "volume"]).select("symbol", "bucket", "close_norm", "volume_norm")


@query(f"""with {TICKS}, {bars_sql()}, p as (select symbol, bucket, row_number() over (partition by symbol order by bucket) as k, count(*) over (partition by symbol) as n from bars)
select symbol, bucket, case when k <= floor(n * 0.6) then 'train' when k <= floor(n * 0.8) then 'valid' else 'test' end as part from p""")
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    return features.split_by_time(bars(spark, folder), ["symbol"], ["bucket"], {"train": 0.6, "valid": 0.2, "test": 0.2}).select("symbol", "bucket", "part")


MESSAGES = """ms as (
  select event_type as symbol, event_id as seq, epoch_us(ts) as us, event_id % 50 = 0 as snap, case when user_id % 2 = 0 then 'bid' else 'ask' end as side, round(value) as price,
         cast(case when cast(regexp_extract(props, '([0-9]+)', 1) as int) % 10 = 0 then 0 else cast(regexp_extract(props, '([0-9]+)', 1) as int) end as double) as size from events),
ep as (select *, sum(cast(snap as int)) over (partition by symbol order by seq) as epoch from ms),
lv as (select *, coalesce(lead(seq) over (partition by symbol, epoch, side, price order by seq), 9e18) as until, size - coalesce(lag(size) over (partition by symbol, epoch, side, price order by seq), 0) as change from ep)"""
STATES = MESSAGES + """,
bs as (select a.symbol, a.seq, a.us, max(b.price) filter (b.side = 'bid') as best_bid, min(b.price) filter (b.side = 'ask') as best_ask, coalesce(sum(b.size) filter (b.side = 'bid'), 0) as bid_depth, coalesce(sum(b.size) filter (b.side = 'ask'), 0) as ask_depth
  from ep a left join lv b on b.symbol = a.symbol and b.epoch = a.epoch and b.seq <= a.seq and a.seq < b.until and (b.size <> 0 or b.snap) group by 1, 2, 3),
bk as (select s.*, (best_bid + best_ask) / 2 as mid, best_ask - best_bid as spread, b.size as bid_size, a.size as ask_size, coalesce((bid_depth - ask_depth) / nullif(bid_depth + ask_depth, 0), 0) as imbalance
  from bs s join ep e on e.symbol = s.symbol and e.seq = s.seq
  left join lv b on b.symbol = s.symbol and b.epoch = e.epoch and b.side = 'bid' and b.price = s.best_bid and b.seq <= s.seq and s.seq < b.until
  left join lv a on a.symbol = s.symbol and a.epoch = e.epoch and a.side = 'ask' and a.price = s.best_ask and a.seq <= s.seq and s.seq < a.until)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return as_messages(market.table(spark, folder, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    """Book messages made of the events: every fiftieth is a snapshot, the rest deltas, of one level each."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = F.struct(F.round("value").alias("price"), F.when(k % 10 == 0, 0).otherwise(k).cast("double").alias("size"))
    none = F.array().cast("array<struct<price: double, size: double>>")
    is_bid = F.col("user_id") % 2 == 0
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), us.alias("us"), F.when(F.col("event_id") % 50 == 0, "snapshot").otherwise("delta").alias("type"), F.when(is_bid, F.array(level)).otherwise(none).alias("bids"), F.when(is_bid, none).otherwise(F.array(level)).alias("asks"))


@query(f"with {MESSAGES}, p as (select symbol, epoch, seq, us, sum(case when side = 'bid' then change else 0 end) over w as bid_depth, sum(case when side = 'ask' then change else 0 end) over w as ask_depth from lv window w as (partition by symbol, epoch order by seq)) select symbol, seq, us, round(bid_depth, 6) as bid_depth, round(ask_depth, 6) as ask_depth, round(coalesce((bid_depth - ask_depth) / nullif(bid_depth + ask_depth, 0), 0), 6) as imbalance from p")
def book_depths(spark: SparkSession, folder: str) -> DataFrame:
    return book.depths(messages(spark, folder))


@query(f"with {STATES} select symbol, seq, us, {r('best_bid', 'best_ask', 'bid_depth', 'ask_depth', 'mid', 'spread', 'imbalance')}, round(case when best_bid is not null and best_ask is not null and bid_size + ask_size > 0 then (best_bid * ask_size + best_ask * bid_size) / (bid_size + ask_size) else mid end, 6) as micro from bk")
def book_states(spark: SparkSession, folder: str) -> DataFrame:
    return book.states(messages(spark, folder)).select("symbol", "seq", "us", "best_bid", "best_ask", "bid_depth", "ask_depth", "mid", "spread", "imbalance", "micro")


@query(f"""with {STATES}, l as (select *, ln(mid / lag(mid) over (partition by symbol order by seq)) as lr from bk)
select symbol, seq, round(coalesce(spread, 0), 6) as spread, {", ".join(f"round(case when count(mid) over (partition by symbol order by seq rows {k - 1} preceding) >= {k} then stddev_pop(lr) over (partition by symbol order by seq rows {k - 2} preceding) else 0 end, 6) as vol_{k}, round(case when count(*) over (partition by symbol order by seq rows {k - 1} preceding) >= {k} then avg(imbalance) over (partition by symbol order by seq rows {k - 1} preceding) else 0 end, 6) as voi_{k}" for k in (10, 50, 100))},
  round(sin(2 * pi() * (us % 86400000000) / 86400000000), 6) as time_sin, round(cos(2 * pi() * (us % 86400000000) / 86400000000), 6) as time_cos from l""")
def book_features(spark: SparkSession, folder: str) -> DataFrame:
    out = book.market_features(book.states(messages(spark, folder)))
    return out.select("symbol", "seq", "spread", "vol_10", "voi_10", "vol_50", "voi_50", "vol_100", "voi_100", "time_sin", "time_cos")


LEVELS = STATES + """, live as (select s.symbol, s.seq, b.side, b.price, b.size, row_number() over (partition by s.symbol, s.seq, b.side order by case when b.side = 'bid' then -b.price else b.price end) as rank
    from bs s join ep e on e.symbol = s.symbol and e.seq = s.seq join lv b on b.symbol = s.symbol and b.epoch = e.epoch and b.seq <= s.seq and s.seq < b.until and (b.size <> 0 or b.snap)),
held as (select s.symbol, s.seq, d.side, d.sign, count(l.price) as n, coalesce(case when d.side = 'bid' then min(l.price) else max(l.price) end, coalesce(any_value(case when d.side = 'bid' then best_ask else best_bid end), 1000) + d.sign * 0.01) as edge
    from bs s cross join (values ('bid', -1), ('ask', 1)) d(side, sign) left join (select * from live where rank <= 10) l on l.symbol = s.symbol and l.seq = s.seq and l.side = d.side group by 1, 2, 3, 4),
tops as (select symbol, seq, side, cast(rank as int) as rank, price, size from live where rank <= 10
  union all select symbol, seq, side, cast(n + k as int), edge + sign * 0.01 * k, 0 from held, (select unnest(range(1, 11)) as k) where n + k <= 10)"""


@query(f"with {LEVELS} select symbol, seq, side, rank, round(price, 6) as price, size from tops")
def book_levels(spark: SparkSession, folder: str) -> DataFrame:
    tops = book.states(messages(spark, folder), 10)
    sides = tops.select("symbol", "seq", F.explode(F.array(*(F.struct(F.lit(s[:-1]).alias("side"), F.col(s).alias("levels")) for s in ("bids", "asks")))).alias("s"))
    return sides.select("symbol", "seq", "s.side", F.posexplode("s.levels").alias("rank", "l")).select("symbol", "seq", "side", (F.col("rank") + 1).alias("rank"), "l.price", "l.size")


def _order_flow(k: int) -> str:
    span = f"t.us >= a.us - {k * 100_000} and t.us <= a.us"
    return f"coalesce((sum(quantity) filter (not is_buyer_maker and {span}) - sum(quantity) filter (is_buyer_maker and {span})) / nullif(sum(quantity) filter ({span}), 0), case when sum(quantity) filter ({span}) > 0 then 2 * cast(bool_or(not is_buyer_maker) filter ({span}) as int) - 1 else 0 end)"


#: Lookbacks of the order flow, in tenths of a second: the tables' ticks are sparse.
FLOWS = (36_000, 216_000)


@query(f"""with {TICKS}, a as (select event_type as symbol, event_id as seq, epoch_us(ts) as us from events)
select a.symbol, a.seq, {", ".join(f"round({_order_flow(k)}, 6) as ofi_{k}" for k in FLOWS)} from a left join ticks t on t.symbol = a.symbol and t.us <= a.us and t.us >= a.us - {max(FLOWS) * 100_000} group by 1, 2""")
def order_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Imbalance of the trades of the last hour and six hours at every message."""
    rows = messages(spark, folder).select("symbol", "seq", "us")
    return book.order_flow(rows, market.ticks(spark, folder), FLOWS).select("symbol", "seq", *(f"ofi_{k}" for k in FLOWS))


def _back(k: int) -> str:
    return f"over (partition by symbol order by seq rows {k - 1} preceding)"


_VOL = {f"vol_{k}": f"case when count(mid) {_back(k)} >= {k} then stddev_pop(lr) {_back(k - 1)} else 0 end" for k in (10, 50, 100)}
_VOI = {f"voi_{k}": f"case when count(*) {_back(k)} >= {k} then avg(imbalance) {_back(k)} else 0 end" for k in (10, 50, 100)}
#: The market features in the vector's order, that of the alphabet.
_MARKET = sorted((_VOL | _VOI | {f"ofi_{k}": "0" for k in (10, 50, 100)} | {
    "mid_price": "coalesce(mid, 0)", "spread": "coalesce(spread, 0)", "bid_depth": "bid_depth", "ask_depth": "ask_depth", "time_sin": "sin(2 * pi() * (us % 86400000000) / 86400000000)", "time_cos": "cos(2 * pi() * (us % 86400000000) / 86400000000)",
    "micro_price": "coalesce(case when best_bid is not null and best_ask is not null and bid_size + ask_size > 0 then (best_bid * ask_size + best_ask * bid_size) / (bid_size + ask_size) else mid end, 0)",
}).items())


@query(f"""with {LEVELS}, l as (select *, ln(mid / lag(mid) over (partition by symbol order by seq)) as lr from bk),
ft as (select symbol, seq, [{", ".join(f"cast({sql} as double)" for _, sql in _MARKET)}] as v from l),
lt as (select t.*, case when coalesce(b.mid, 0) = 0 then 1 else b.mid end as mid, case when side = 'ask' then 20 else 0 end + 2 * (rank - 1) as first from tops t join bk b on b.symbol = t.symbol and b.seq = t.seq)
select symbol, seq, cast(first as int) as place, round(price / mid, 6) as value from lt
union all select symbol, seq, cast(first + 1 as int), round(size, 6) from lt
union all select symbol, seq, cast(40 + k as int), round(case when k < {len(_MARKET)} then v[k + 1] else 0 end, 6) from ft, (select unnest(range(24)) as k)""")
def state_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 64 numbers of the state after each message, a row a number."""
    rows = book.market_features(stored(book.states(messages(spark, folder), 10), "states"))
    return book.state_vector(rows).select("symbol", "seq", F.posexplode("vector").alias("place", "value"))


@query(f"""with {STATES}, hb as (select symbol, seq, round(coalesce(mid, 0), 6) as mid, round(imbalance, 6) as imbalance, row_number() over (partition by symbol order by seq) as k from bk), hp as (select unnest(range(20)) as place)
select h.symbol, h.seq, cast(place as int) as place, c.mid, c.imbalance from hb h cross join hp join hb c on c.symbol = h.symbol and c.k = greatest(h.k - 19 + place, 1)""")
def state_histories(spark: SparkSession, folder: str) -> DataFrame:
    """The last 20 pairs of mid and imbalance after each message, a row a pair."""
    rows = stored(book.states(messages(spark, folder)).select("symbol", "seq", F.struct(F.coalesce("mid", F.lit(0.0)).alias("mid"), "imbalance").alias("pair")), "states")
    kept = book.history(rows, ["symbol"], ["seq"], "pair")
    return kept.select("symbol", "seq", F.posexplode("history").alias("place", "pair")).select("symbol", "seq", "place", "pair.*")


ADVANTAGES = f"""with recursive {TICKS}, s as (select symbol, trade_id as step, price / 100 as reward, quantity / 100 as value, trade_id % 97 = 0 as done, row_number() over (partition by symbol order by trade_id desc) as k,
  coalesce(lead(quantity / 100) over (partition by symbol order by trade_id), 0) as ahead from ticks),
d as (select *, reward + 0.99 * case when done then 0 else ahead end - value as delta from s),
g as (select symbol, step, k, value, delta as advantage from d where k = 1 union all select d.symbol, d.step, d.k, d.value, d.delta + 0.99 * 0.95 * case when d.done then 0 else g.advantage end from g join d on d.symbol = g.symbol and d.k = g.k + 1)
select symbol, step, round(advantage, 6) as advantage, round(advantage + value, 6) as target, round((advantage - avg(advantage) over (partition by symbol)) / (stddev_pop(advantage) over (partition by symbol) + 1e-8), 6) as advantage_norm from g"""


@query(ADVANTAGES)
def advantage_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Each symbol's ticks are one path."""
    steps = market.ticks(spark, folder).select("symbol", F.col("trade_id").alias("step"), (F.col("price") / 100).alias("reward"), (F.col("quantity") / 100).alias("value"), (F.col("trade_id") % 97 == 0).alias("done"))
    return paths.advantages(steps, ["symbol"], "step").select("symbol", "step", "advantage", "target", "advantage_norm")


@query(f"""with {STATES}, f as (select symbol, seq, case when seq % 2 = 0 then 'buy' else 'sell' end as side, mid as price, lead(mid, 9) over (partition by symbol order by seq) as later from bk)
select symbol, seq, round(case when side = 'buy' then price - later else later - price end, 6) as markout from f""")
def markouts(spark: SparkSession, folder: str) -> DataFrame:
    s = book.states(messages(spark, folder)).select("symbol", "seq", "mid")
    fills = s.select("symbol", "seq", F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("mid").alias("price"))
    return book.markouts(fills, s).select("symbol", "seq", "markout")


RETURNS = f"""with {TICKS}, {bars_sql()}, re as (select symbol, bucket, close, volume, ln(close / lag(close) over (partition by symbol order by bucket)) as ret from bars where close > 0),
rt as (select * from re where ret is not null)"""


def bar_returns(spark: SparkSession, folder: str) -> DataFrame:
    w = series.ordered(["symbol"], ["bucket"])
    df = bars(spark, folder).where("close > 0").withColumn("ret", F.ln(F.col("close") / F.lag("close").over(w)))
    return df.where("ret is not null").select("symbol", "bucket", "close", "volume", "ret")


@query(f"{RETURNS} select symbol, count(ret) as n, round(avg(ret), 8) as mean, round(var_pop(ret), 8) as variance, round(avg(ret) / (var_pop(ret) + avg(ret) * avg(ret)), 6) as kelly, round(avg(ret) / var_pop(ret), 6) as kelly_approx from rt group by 1", digits=8)
def kelly(spark: SparkSession, folder: str) -> DataFrame:
    return research.kelly(bar_returns(spark, folder), ["symbol"], "ret").withColumns({c: F.round(c, 6) for c in ("kelly", "kelly_approx")})


AR1 = RETURNS + """, pr as (select *, lag(ret) over (partition by symbol order by bucket) as before from rt),
ar as (select symbol, count(*) as n, regr_slope(ret, before) as rho, regr_intercept(ret, before) as intercept, var_pop(ret) as variance, regr_r2(ret, before) as r2 from pr where before is not null group by 1)"""


@query(f"{AR1} select symbol, n, round(rho, 6) as rho, round(intercept / (1 - rho), 6) as mu, round(variance, 6) as variance, round(variance * (1 - r2), 6) as residual, round(1 - rho * rho, 6) as risk_share from ar")
def ar1(spark: SparkSession, folder: str) -> DataFrame:
    return research.ar1(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret")


@query(f"""{AR1}, m as (select pr.symbol, bucket, intercept / (1 - rho) + rho * (before - intercept / (1 - rho)) as m, variance * (1 - r2) as residual from pr join ar using (symbol))
select symbol, bucket, round(m, 6) as m, round(m / (residual + m * m), 6) as kelly, round(m / residual, 6) as kelly_approx from m""")
def conditional_kelly(spark: SparkSession, folder: str) -> DataFrame:
    return research.conditional_kelly(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret").select("symbol", "bucket", "m", "kelly", "kelly_approx")


def residual_sql(name: str, source: str, columns: list[str]) -> str:
    """CTEs that end in ``name`` (symbol, n, rss): the squares of the last column left by the others and a constant."""
    k = len(columns) - 1
    at = lambda i, j: f"s{min(i, j)}_{max(i, j)}"
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    steps = [f"{name}0 as (select symbol, count(*) as n, {', '.join(f'covar_pop({columns[i]}, {columns[j]}) * count(*) as {at(i, j)}' for i, j in cells)} from {source} group by 1)"]
    for p in range(k):
        left = [(i, j) for i, j in cells if i > p]
        steps.append(f"{name}{p + 1} as (select symbol, n, {', '.join(f'{at(i, j)} - {at(p, i)} * {at(p, j)} / {at(p, p)} as {at(i, j)}' for i, j in left)} from {name}{p})")
    return ", ".join(steps) + f", {name} as (select symbol, n, {at(k, k)} as rss from {name}{k})"


@query(f"""{RETURNS}, lg as (select symbol, ret, lag(ret) over w as y1, lag(ret, 2) over w as y2, lag(volume) over w as x1, lag(volume, 2) over w as x2 from rt window w as (partition by symbol order by bucket)),
gr as (select * from lg where y2 is not null and x2 is not null), {residual_sql("few", "gr", ["y1", "y2", "ret"])}, {residual_sql("full_", "gr", ["y1", "y2", "x1", "x2", "ret"])}
select symbol, few.n, round((few.rss - full_.rss) / 2 / (full_.rss / (few.n - 5)), 6) as f, 2 as df1, few.n - 5 as df2 from few join full_ using (symbol)""")
def granger(spark: SparkSession, folder: str) -> DataFrame:
    return research.granger(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret", "volume")


PAIRS = RETURNS + """, vr as (select symbol, ret, volume, lag(ret) over w as a0, lag(volume) over w as b0, ret - lag(ret) over w as da, volume - lag(volume) over w as db from rt window w as (partition by symbol order by bucket)),
mo as (select symbol, count(*) as n, avg(a0) as ma, avg(b0) as mb, avg(ret) as mr, avg(volume) as mv, var_pop(a0) as aa, var_pop(b0) as bb, covar_pop(a0, b0) as ab, covar_pop(a0, ret) as ar, covar_pop(b0, ret) as br, covar_pop(a0, volume) as av, covar_pop(b0, volume) as bv,
  var_pop(ret) as rr, var_pop(volume) as vv, var_pop(da) as d00, covar_pop(da, db) as d01, var_pop(db) as d11, covar_pop(da, a0) as c00, covar_pop(da, b0) as c01, covar_pop(db, a0) as c10, covar_pop(db, b0) as c11 from vr where a0 is not null group by 1)"""


@query(f"""{PAIRS}, co as (select *, aa * bb - ab * ab as det, (ar * bb - br * ab) / (aa * bb - ab * ab) as a_a, (br * aa - ar * ab) / (aa * bb - ab * ab) as a_b, (av * bb - bv * ab) / (aa * bb - ab * ab) as b_a, (bv * aa - av * ab) / (aa * bb - ab * ab) as b_b from mo)
select symbol, n, {r("a_a", "a_b", "b_a", "b_b")}, round(mr - a_a * ma - a_b * mb, 6) as a_const, round(mv - b_a * ma - b_b * mb, 6) as b_const, round((rr - a_a * ar - a_b * br) * n / (n - 3), 6) as a_variance, round((vv - b_a * av - b_b * bv) * n / (n - 3), 6) as b_variance from co""")
def vector_regression(spark: SparkSession, folder: str) -> DataFrame:
    return research.vector_regression(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret", "volume")


@query(f"""{PAIRS}, inv as (select *, d11 / (d00 * d11 - d01 * d01) as i00, -d01 / (d00 * d11 - d01 * d01) as i01, d00 / (d00 * d11 - d01 * d01) as i11, bb / (aa * bb - ab * ab) as k00, -ab / (aa * bb - ab * ab) as k01, aa / (aa * bb - ab * ab) as k11 from mo),
q as (select *, c00 * i00 * c00 + 2 * c00 * i01 * c10 + c10 * i11 * c10 as q00, c00 * i00 * c01 + c00 * i01 * c11 + c10 * i01 * c01 + c10 * i11 * c11 as q01, c01 * i00 * c01 + 2 * c01 * i01 * c11 + c11 * i11 * c11 as q11 from inv),
ms as (select symbol, n, k00 * q00 + k01 * q01 as m00, k00 * q01 + k01 * q11 as m01, k01 * q00 + k11 * q01 as m10, k01 * q01 + k11 * q11 as m11 from q),
la as (select symbol, n, (m00 + m11) / 2 + sqrt((m00 + m11) ** 2 / 4 - (m00 * m11 - m01 * m10)) as lambda1, (m00 + m11) / 2 - sqrt((m00 + m11) ** 2 / 4 - (m00 * m11 - m01 * m10)) as lambda2 from ms)
select symbol, n, {r("lambda1", "lambda2")}, round(-n * (ln(1 - lambda1) + ln(1 - lambda2)), 4) as trace_none, round(-n * ln(1 - lambda2), 4) as trace_one from la""")
def johansen(spark: SparkSession, folder: str) -> DataFrame:
    out = research.johansen(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret", "volume")
    return out.withColumns({c: F.round(c, 4) for c in ("trace_none", "trace_one")})


@query(f"""{RETURNS}, d as (select symbol, close - lag(close) over w as d, lag(close) over w as b from rt window w as (partition by symbol order by bucket)),
u as (select symbol, count(*) as n, regr_slope(d, b) as slope, regr_sxx(d, b) as sxx, regr_syy(d, b) as syy, regr_sxy(d, b) as sxy from d where b is not null group by 1)
select symbol, n, round(slope, 6) as slope, round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 6) as t from u""")
def unit_root(spark: SparkSession, folder: str) -> DataFrame:
    return research.unit_root(bar_returns(spark, folder), ["symbol"], ["bucket"], "close")


def swept_sql(name: str, source: str, columns: list[str], out: list[str]) -> str:
    """CTEs that end in ``name``: sums of products (s_a_b) of the columns about their means, after the columns ``out`` are regressed out of the rest."""
    at = lambda a, b: f"s_{a}_{b}" if columns.index(a) <= columns.index(b) else f"s_{b}_{a}"
    pairs = [(a, b) for a in columns for b in columns[columns.index(a) :]]
    steps = [f"{name}_0 as (select symbol, count(*) as n, {', '.join(f'covar_pop({a}, {b}) * count(*) as {at(a, b)}' for a, b in pairs)} from {source} group by 1)"]
    for k, p in enumerate(out):
        pairs = [(a, b) for a, b in pairs if p not in (a, b)]
        steps.append(f"{name}_{k + 1} as (select symbol, n, {', '.join(f'{at(a, b)} - {at(p, a)} * {at(p, b)} / {at(p, p)} as {at(a, b)}' for a, b in pairs)} from {name}_{k})")
    return ", ".join(steps) + f", {name} as (select * from {name}_{len(out)})"


ROOT_VALUE = "(-2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3)"


def root_sql(name: str, source: str, level: str, lagged: list[str], change: str) -> str:
    """CTEs that end in ``name`` (symbol, n, lag, slope, t): the regression of the change on the level and as many lagged changes as Akaike's criterion takes."""
    fits, steps = [], []
    for p in range(len(lagged) + 1):
        steps.append(swept_sql(f"{name}_f{p}", source, [*lagged[:p], level, change], lagged[:p]))
        ll, ld, dd = f"s_{level}_{level}", f"s_{level}_{change}", f"s_{change}_{change}"
        rest = f"({dd} - {ld} * {ld} / {ll})"
        fits.append(f"select symbol, n, {p} as lag, {ld} / {ll} as slope, {ld} / {ll} / sqrt({rest} / (n - {p + 2}) / {ll}) as t, n * ln({rest} / n) + 2 * {p + 2} as aic from {name}_f{p}")
    return ", ".join(steps) + f", {name} as (select * from ({' union all '.join(fits)}) qualify row_number() over (partition by symbol order by aic, lag) = 1)"


@query(f"""{RETURNS}, lv as (select symbol, bucket, close - lag(close) over w as d, lag(close) over w as l from rt window w as (partition by symbol order by bucket)),
lg as (select *, {", ".join(f"lag(d, {k}) over w as d{k}" for k in (1, 2, 3))} from lv window w as (partition by symbol order by bucket)), lr as (select * from lg where d3 is not null),
{root_sql("ur", "lr", "l", ["d1", "d2", "d3"], "d")}
select symbol, n, lag, round(slope, 6) as slope, round(t, 5) as t, round({ROOT_VALUE}, 6) as critical, t < {ROOT_VALUE} as stationary from ur""")
def augmented_unit_root(spark: SparkSession, folder: str) -> DataFrame:
    out = cointegration.augmented_unit_root(bar_returns(spark, folder), ["symbol"], ["bucket"], "close", 3)
    return out.withColumn("t", F.round("t", 5))


@query(f"""{RETURNS}, lv as (select symbol, bucket, close - lag(close) over w as dy, lag(close) over w as ly, volume - lag(volume) over w as dx, lag(volume) over w as lx from rt window w as (partition by symbol order by bucket)),
lg as (select *, lag(dy) over w as dy1, lag(dx) over w as dx1 from lv window w as (partition by symbol order by bucket)), lr as (select * from lg where dy1 is not null and dx1 is not null),
{root_sql("uy", "lr", "ly", ["dy1"], "dy")}, {root_sql("ux", "lr", "lx", ["dx1"], "dx")},
{swept_sql("b", "lr", ["dy1", "dx1", "ly", "lx", "dy", "dx"], ["dy1", "dx1"])},
inv as (select *, s_dy_dy * s_dx_dx - s_dy_dx ** 2 as d0, s_ly_ly * s_lx_lx - s_ly_lx ** 2 as d1 from b),
q as (select *, (s_ly_dy * s_dx_dx * s_ly_dy - 2 * s_ly_dy * s_dy_dx * s_ly_dx + s_ly_dx * s_dy_dy * s_ly_dx) / d0 as q00, (s_ly_dy * s_dx_dx * s_lx_dy - s_ly_dy * s_dy_dx * s_lx_dx - s_ly_dx * s_dy_dx * s_lx_dy + s_ly_dx * s_dy_dy * s_lx_dx) / d0 as q01,
  (s_lx_dy * s_dx_dx * s_lx_dy - 2 * s_lx_dy * s_dy_dx * s_lx_dx + s_lx_dx * s_dy_dy * s_lx_dx) / d0 as q11 from inv),
m as (select *, (s_lx_lx * q00 - s_ly_lx * q01) / d1 as m00, (s_lx_lx * q01 - s_ly_lx * q11) / d1 as m01, (s_ly_ly * q01 - s_ly_lx * q00) / d1 as m10, (s_ly_ly * q11 - s_ly_lx * q01) / d1 as m11 from q),
e as (select *, (m00 + m11) / 2 + sqrt((m00 + m11) ** 2 / 4 - (m00 * m11 - m01 * m10)) as e1, (m00 + m11) / 2 - sqrt((m00 + m11) ** 2 / 4 - (m00 * m11 - m01 * m10)) as e2 from m),
t as (select *, -n * (ln(1 - e1) + ln(1 - e2)) as t0, -n * ln(1 - e2) as t1, (e1 - m00) / m01 as beta from e),
j as (select *, case when t0 < 15.4943 then 0 when t1 < 3.8415 then 1 else 2 end as rank, s_ly_ly + 2 * beta * s_ly_lx + beta ** 2 * s_lx_lx as ee, s_ly_dy + beta * s_lx_dy as ed, s_ly_dx + beta * s_lx_dx as ex from t),
{swept_sql("lf", "lr", ["ly", "lx", "dy"], ["ly"])}, {swept_sql("lu", "lr", ["ly", "lx", "dy"], ["ly", "lx"])}, {swept_sql("cf", "lr", ["dy1", "dx1", "dy"], ["dy1"])}, {swept_sql("cu", "lr", ["dy1", "dx1", "dy"], ["dy1", "dx1"])},
md as (select j.*, uy.lag as lag_y, uy.t as t_y, ux.lag as lag_x, ux.t as t_x, case when uy.t < {ROOT_VALUE.replace("n", "j.n")} and ux.t < {ROOT_VALUE.replace("n", "j.n")} then 'levels' when rank > 0 then 'error correction' else 'changes' end as model,
  lf.s_dy_dy as lf, lu.s_dy_dy as lu, cf.s_dy_dy as cf, cu.s_dy_dy as cu from j join uy using (symbol) join ux using (symbol) join lf using (symbol) join lu using (symbol) join cf using (symbol) join cu using (symbol))
select symbol, n, lag_y, round(t_y, 5) as t_y, lag_x, round(t_x, 5) as t_x, round(t0, 4) as trace_none, round(t1, 4) as trace_one, rank, round(beta, 6) as beta, round(ed / ee, 6) as alpha_y, round(ex / ee, 6) as alpha_x, model,
  round(case model when 'levels' then (lf - lu) / (lu / (n - 3)) when 'changes' then (cf - cu) / (cu / (n - 3)) else (cf - (s_dy_dy - ed ** 2 / ee)) / 2 / ((s_dy_dy - ed ** 2 / ee) / (n - 4)) end, 5) as f,
  case when model = 'error correction' then 2 else 1 end as df1, n - case when model = 'error correction' then 4 else 3 end as df2 from md""")
def influence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether volume helps to predict the close, each symbol by the model that fits its series."""
    out = cointegration.influence(bar_returns(spark, folder), ["symbol"], ["bucket"], "close", "volume", 1)
    return out.withColumns({c: F.round(c, d) for c, d in {"t_y": 5, "t_x": 5, "trace_none": 4, "trace_one": 4, "f": 5}.items()})


CHOW_AT = 1705276800_000000


@query(f"""{RETURNS}, w as (select symbol, count(*) as n, regr_syy(ret, volume) * (1 - regr_r2(ret, volume)) as rss from rt group by 1),
h as (select symbol, sum(rss) as rss from (select symbol, bucket >= {CHOW_AT} as late, regr_syy(ret, volume) * (1 - regr_r2(ret, volume)) as rss from rt group by 1, 2) group by 1)
select symbol, n, round((w.rss - h.rss) / 2 / (h.rss / (n - 4)), 6) as f, 2 as df1, n - 4 as df2 from w join h using (symbol)""")
def chow(spark: SparkSession, folder: str) -> DataFrame:
    return research.chow(bar_returns(spark, folder), ["symbol"], "ret", "volume", F.col("bucket") >= CHOW_AT)


@query(f"""{RETURNS}, f as (select *, ntile(5) over (partition by symbol order by bucket) as fold from rt),
g as (select a.symbol, a.fold, (select stddev_samp(ret) from f b where b.symbol = a.symbol and b.fold < a.fold) as sd0, (select avg(ret) from f b where b.symbol = a.symbol and b.fold < a.fold) as m0, count(*) as n, avg(ret) as mean, avg(ret) / stddev_samp(ret) as sharpe from f a group by 1, 2)
select symbol, cast(fold as int) as fold, n, {r('mean', 'sharpe')}, round(m0 / sd0, 6) as sharpe_before from g""")
def walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    return research.fold_figures(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret", 5)


@query(f"{RETURNS}, l as (select unnest([10.0, 50.0, 100.0, 200.0])::double as lim) select symbol, lim as \"limit\", count(*) as n, round(avg(ret), 6) as mean_return from rt, l where volume > lim group by 1, 2")
def sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return research.sensitivity(bar_returns(spark, folder), ["symbol"], "volume", "ret", [10.0, 50.0, 100.0, 200.0])


@query(f"""{RETURNS} select symbol, bucket, round(case when count(*) over w >= 24 then stddev_samp(ret) over w end, 6) as roll_sd, round(case when count(*) over w >= 24 then avg(ret) over w / stddev_samp(ret) over w end, 6) as roll_sharpe,
  round(case when count(*) over w >= 24 then corr(ret, volume) over w end, 6) as roll_corr from rt window w as (partition by symbol order by bucket rows 23 preceding)""")
def rolling_relations(spark: SparkSession, folder: str) -> DataFrame:
    return research.rolling_relations(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret", "volume", 24).select("symbol", "bucket", "roll_sd", "roll_sharpe", "roll_corr")


@query(f"""{RETURNS}, z as (select symbol, bucket, case when count(*) over w >= 24 then (volume - avg(volume) over w) / nullif(stddev_samp(volume) over w, 0) end as z from rt window w as (partition by symbol order by bucket rows between 24 preceding and 1 preceding))
select symbol, bucket, round(z, 6) as z, coalesce(abs(z) > 3, false) as anomaly from z""")
def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return research.anomalies(bar_returns(spark, folder), ["symbol"], ["bucket"], "volume", 24, 3.0).select("symbol", "bucket", "z", "anomaly")


@query(f"""{RETURNS}, b as (select least(greatest(floor((ret + 5) / 10 * 10), 0), 9) as bin, bucket < {CHOW_AT} as ref from rt), n as (select count(*) filter (ref) as na, count(*) filter (not ref) as nb from b),
c as (select range as bin, count(*) filter (ref) as a, count(*) filter (not ref and ref is not null) as b from range(10) left join b on b.bin = range group by 1)
select round(sum(((a + 0.5) / (na + 5) - (b + 0.5) / (nb + 5)) * ln(((a + 0.5) / (na + 5)) / ((b + 0.5) / (nb + 5)))), 6) as psi from c, n""")
def drift(spark: SparkSession, folder: str) -> DataFrame:
    df = bar_returns(spark, folder)
    return research.drift(df.where(F.col("bucket") < CHOW_AT), df.where(F.col("bucket") >= CHOW_AT), "ret", 10, -5.0, 5.0)


@query(f"""{RETURNS}, e as (select *, case when count(*) over w >= 24 then stddev_samp(ret) over w end as sd, sum(ret) over (partition by symbol order by bucket) as equity from rt window w as (partition by symbol order by bucket rows 23 preceding)),
d as (select *, greatest(max(equity) over (partition by symbol order by bucket), 0) - equity as drawdown from e),
t as (select *, case when drawdown >= 6 then 3 when drawdown >= 4 then 2 when drawdown >= 2 then 1 else 0 end as tier from d)
select symbol, bucket, round(case when tier = 3 then 0 else least(coalesce(1 / nullif(sd, 0), 2), 2) end, 6) as leverage, {r('equity', 'drawdown')}, tier from t""")
def risk_levels(spark: SparkSession, folder: str) -> DataFrame:
    out = research.risk_levels(bar_returns(spark, folder), ["symbol"], ["bucket"], "ret", 24, 1.0, 2.0, (2.0, 4.0, 6.0))
    return out.select("symbol", "bucket", "leverage", "equity", "drawdown", "tier")


@query(f"{TRADES} select symbol, trade_id, round(exit_price / entry_price - 1 - 0.0015, 6) as pnl_net from tr where exit_us is not null")
def repriced_trades(spark: SparkSession, folder: str) -> DataFrame:
    return research.repriced(backtest.trades(positioned(spark, folder)), 15).select("symbol", "trade_id", "pnl_net")


@query(f"""{SIZED}, ws as (select *, coalesce(ret_net, 0) as r0, count(*) over (partition by symbol) as n, row_number() over (partition by symbol order by us) as k from eq),
z as (select *, greatest(least(n // 5, 390), 10) as size, avg(r0) over (partition by symbol) as mean from ws),
rd as (select a.symbol, a.us, any_value(a.mean) as mean, case when any_value(a.n) > any_value(a.size) and any_value(a.k) >= any_value(a.size) then stddev_samp(b.r0) end as sd from z a join z b on b.symbol = a.symbol and b.k > a.k - a.size and b.k <= a.k group by 1, 2)
select symbol, us, round(mean * 98280 / (nullif(sd, 0) * sqrt(98280)), 5) as rolling_sharpe from rd""", digits=5)
def rolling_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.rolling_sharpe(equity(spark, folder)).select("symbol", "us", "rolling_sharpe")


@query(f"""{SIZED} select symbol, us, round(close / arg_min(close, us) over (partition by symbol), 6) as benchmark from eq""")
def benchmark_curve(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.benchmark(as_bars(bars(spark, folder))).select("symbol", "us", "benchmark")


@query(f"""{TRADES}, ct as (select symbol, trade_id, sum(100 * (exit_price / entry_price - 1)) over (partition by symbol order by trade_id) as cum_pnl from tr where exit_us is not null)
select symbol, trade_id, round(cum_pnl, 6) as cum_pnl, round(coalesce(lag(cum_pnl) over (partition by symbol order by trade_id), 0), 6) as before from ct""")
def cumulative_trades(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.cumulative_trades(backtest.trades(positioned(spark, folder))).select("symbol", "trade_id", "cum_pnl", "before")


@query(f"""{TRADES}, wl as (select symbol, exit_price / entry_price - 1 as p from tr where exit_us is not null)
select symbol, count(*) filter (p > 0) as wins, count(*) filter (p <= 0) as losses, round(max(p), 6) as largest_win, round(min(p), 6) as largest_loss, round(count(*) filter (p > 0) / count(*), 6) as win_share, round(count(*) filter (p <= 0) / count(*), 6) as loss_share from wl group by 1""")
def win_loss(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.win_loss(backtest.trades(positioned(spark, folder)))


@query(f"{POSITIONS}, sc as (select symbol, pos - lag(pos) over (partition by symbol order by us) as d from pos) select symbol, count(*) filter (d > 0) as entries, count(*) filter (d < 0) as exits from sc group by 1")
def signal_changes(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.signal_changes(positioned(spark, folder))


@query(f"""{RETURNS}, late as (select symbol, bucket, bucket + case when bucket // {HOUR * US} % 7 = 0 then {HOUR * US} else 0 end as seen from rt) select symbol, bucket, seen from late where seen > bucket""")
def lookahead(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions at a bar's beginning with data of which every seventh bar's came an hour later."""
    rows = bar_returns(spark, folder).withColumn("seen", F.col("bucket") + F.when(F.floor(F.col("bucket") / (HOUR * US)) % 7 == 0, HOUR * US).otherwise(0))
    return research.lookahead(rows, "seen", "bucket").select("symbol", "bucket", "seen")


def _figure(c: str) -> str:
    return f"select '{c}' as name, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, round(min({c}), 6) as low, round(max({c}), 6) as high from bars"


@query(f"with {TICKS}, {bars_sql()} {' union all '.join(map(_figure, ('open', 'high', 'low', 'close', 'volume')))}")
def described(spark: SparkSession, folder: str) -> DataFrame:
    return candles.described(bars(spark, folder), ["open", "high", "low", "close", "volume"]).drop("q25", "q50", "q75")


#: A day of a symbol's signal backtest as one episode.
EPISODES = BACKTEST + f""",
ep as (select symbol, bucket // {24 * HOUR * US} as day, bucket, pnl, sum(pnl) over (partition by symbol, bucket // {24 * HOUR * US} order by bucket) as path from bt),
df as (select *, case when lag(path) over (partition by symbol, day order by bucket) is not null then pnl end as d, max(path) over (partition by symbol, day order by bucket) - path as dd from ep),
fg as (select symbol, day, arg_max(path, bucket) as final_pnl, case when count(d) < 1 or stddev_pop(d) = 0 then 0 else avg(d) / stddev_pop(d) * sqrt(362880) end as sharpe,
  case when count(d) < 1 then 0 when coalesce(stddev_pop(d) filter (d < 0), 0) = 0 then 10 else avg(d) / stddev_pop(d) filter (d < 0) * sqrt(362880) end as sortino, max(dd) as max_drawdown from df group by 1, 2)"""
FIGURES = ["final_pnl", "sharpe", "sortino", "max_drawdown"]


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    day = F.floor(F.col("bucket") / (24 * HOUR * US))
    rows = backtested(spark, folder).withColumn("day", day)
    rows = rows.withColumn("path", F.sum("pnl").over(series.ordered(["symbol", "day"], ["bucket"])))
    return paths.path_figures(rows, ["symbol", "day"], "bucket", "path", 24 * HOUR * US, "pnl")


@query(f"{EPISODES} select symbol, day, {r('final_pnl', 'max_drawdown')}, round(sharpe, 4) as sharpe, round(sortino, 4) as sortino from fg", digits=6)
def path_figures(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(spark, folder).withColumns({c: F.round(c, 4) for c in ("sharpe", "sortino")})


@query(f"{EPISODES} select count(*) as n, {', '.join(f'round(avg({c}), 4) as {c}' for c in FIGURES)} from fg", digits=4)
def episode_means(spark: SparkSession, folder: str) -> DataFrame:
    return paths.means(episodes(spark, folder), FIGURES)


@query(f"{EPISODES} select symbol, day, {', '.join(f'round(avg({c}) over (partition by symbol order by day rows 49 preceding), 4) as {c}_mean' for c in FIGURES)} from fg", digits=4)
def episode_rolling_means(spark: SparkSession, folder: str) -> DataFrame:
    return paths.rolling_means(episodes(spark, folder), ["symbol"], "day", FIGURES).select("symbol", "day", *(f"{c}_mean" for c in FIGURES))


@query(f"""with {TICKS} select symbol, round(coalesce(sum(price * quantity) filter (is_buyer_maker), 0), 4) as maker_volume, round(coalesce(sum(price * quantity) filter (not is_buyer_maker), 0), 4) as taker_volume, count(*) as n_fills,
  round(sum(price * quantity * case when is_buyer_maker then -0.0002 else 0.0007 end), 6) as fees, round(coalesce(sum(price * quantity) filter (is_buyer_maker) / sum(price * quantity), 0), 6) as maker_ratio, round(avg(case when price > 50 then 1.0 else 0 end), 6) as adverse_ratio, round(avg(price - 50), 6) as mean_adverse_cost from ticks group by 1""")
def fill_figures(spark: SparkSession, folder: str) -> DataFrame:
    """The ticks as fills whose cost is the price above 50."""
    fills = market.ticks(spark, folder).select("symbol", "price", F.col("quantity").alias("size"), (F.col("price") * F.col("quantity") * F.when(F.col("is_buyer_maker"), -0.0002).otherwise(0.0007)).alias("fee"), F.col("is_buyer_maker").alias("is_maker"), (F.col("price") - 50).alias("cost"))
    return paths.fill_figures(fills, ["symbol"]).withColumns({c: F.round(c, 4) for c in ("maker_volume", "taker_volume")})


@query(f"with {TICKS}, {bars_sql()} select symbol, bucket, {r('open', 'high', 'low', 'close', 'volume')}, tick_count from bars")
def streaming_candles(spark: SparkSession, folder: str) -> DataFrame:
    """The events read as a stream until its end; each micro-batch writes the candles it changed, and the last version of each counts."""
    out = shared_folder(spark, "streaming-candles")
    stream = streams.candles(streamed_ticks(spark, folder), HOUR, "1 hour")
    ended(stream.writeStream.outputMode("update").foreachBatch(streams.versions(f"{out}/candles")), out)
    found = streams.newest(spark, f"{out}/candles", ["symbol", "bucket"])
    return found.select("symbol", F.unix_micros("bucket").alias("bucket"), "open", "high", "low", "close", "volume", "tick_count")


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    schema = market.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def streamed_ticks(spark: SparkSession, folder: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return streamed(spark, folder).select(F.col("event_type").alias("symbol"), F.timestamp_micros(us).alias("ts"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"), F.col("event_id").alias("trade_id"))


def ended(writer, out: str) -> None:
    """Runs a stream over what is there."""
    writer.trigger(availableNow=True).option("checkpointLocation", f"{out}/log").start().awaitTermination()


@query(f"with {TICKS} select symbol, count(*) as n, round(avg(price), 6) as mean, round(stddev_samp(price), 6) as sd from ticks group by 1")
def streaming_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics kept from micro-batch to micro-batch; the newest version."""
    out = shared_folder(spark, "streaming-statistics")
    ended(streamed_ticks(spark, folder).writeStream.foreachBatch(streams.stats_by_batch(f"{out}/stats", ["symbol"], "price")), out)
    last = next(k for k in itertools.count() if not market.exists(spark, f"{out}/stats/v{k + 1}"))
    return spark.read.parquet(f"{out}/stats/v{last}")


@query(f"""with {TICKS}, g as (select *, us - lag(us) over (partition by symbol order by us) as gap from ticks), s as (select *, sum(case when gap < {2 * HOUR * US} then 0 else 1 end) over (partition by symbol order by us rows unbounded preceding) as k from g)
select symbol, min(us) as begin_us, max(us) + {2 * HOUR * US} as end_us, count(*) as n, round(sum(quantity), 6) as volume from s group by symbol, k""")
def streaming_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of ticks less than two hours apart."""
    out = shared_folder(spark, "streaming-sessions")
    stream = streams.sessions(streamed_ticks(spark, folder), "2 hours", "1 hour")
    ended(stream.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/sessions")), out)
    return spark.read.parquet(f"{out}/sessions").select("symbol", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n", "volume")


def elapsed_sql(closing: bool) -> str:
    """Sessions as a recursion over each symbol's ticks."""
    over = f"t.us - s.begin_us >= {6 * HOUR * US}"
    over = "s.over" if closing else over
    ends = f"t.us - case when {over} then t.us else s.begin_us end >= {6 * HOUR * US}" if closing else "false"
    return f"""with recursive {TICKS}, t as (select *, row_number() over (partition by symbol order by us, trade_id) as k from ticks),
step as (select symbol, k, us, quantity, us as begin_us, 1 as session, false as over from t where k = 1
  union all select t.symbol, t.k, t.us, t.quantity, case when {over} then t.us else s.begin_us end, s.session + case when {over} then 1 else 0 end, {ends} from step s join t on t.symbol = s.symbol and t.k = s.k + 1)
select symbol, session::bigint as session, min(us) as begin_us, max(us) as last_us, count(*) as n, round(sum(quantity), 6) as volume from step group by 1, 2"""


def in_sessions(spark: SparkSession, folder: str, closing: bool) -> DataFrame:
    rows = chains.elapsed_sessions(market.ticks(spark, folder), ["symbol"], "us", "trade_id", 6 * HOUR * US, closing)
    return rows.groupBy("symbol", "session").agg(F.min("us").alias("begin_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), F.sum("quantity").alias("volume"))


#: An alarm's rule over ticks' prices: tiers, breaches in a row, quiet time, and how late a stream's ticks may come.
TIERS, IN_ROW, QUIET, LATENESS = (60.0, 80.0, 95.0), 2, 2 * HOUR * US, 1


def actions_sql(until: str | None = None) -> str:
    """Alarms from windows over each symbol's breaches."""
    end = f"(select {until} from ticks)"
    seen = f"where us <= {end}" if until else ""
    due = f"where action <> 'release' or us <= {end}" if until else ""
    return f"""with {TICKS}, lv as (select symbol, us, trade_id, (price > {TIERS[0]})::int + (price > {TIERS[1]})::int + (price > {TIERS[2]})::int as lv from ticks {seen}),
cl as (select *, sum((coalesce(lv, 0) = 0)::int) over (partition by symbol order by us, trade_id rows unbounded preceding) as clean from lv),
br as (select *, coalesce(us - lag(us) over w >= {QUIET}, true) as apart, coalesce(lag(clean) over w <> clean, true) as other from cl where lv > 0 window w as (partition by symbol order by us, trade_id)),
al as (select *, sum(apart::int) over w as alarm, sum((apart or other)::int) over w as run from br window w as (partition by symbol order by us, trade_id rows unbounded preceding)),
ps as (select *, row_number() over (partition by symbol, run order by us, trade_id) as place, max(lv) over (partition by symbol, alarm order by us, trade_id rows unbounded preceding) as tier from al),
ra as (select *, count(*) filter (place >= {IN_ROW}) over (partition by symbol, alarm order by us, trade_id rows unbounded preceding) as raised, lag(tier) over (partition by symbol, alarm order by us, trade_id) as before from ps),
ev as (select symbol, us, 'raise' as action, tier from ra where raised = 1 and place >= {IN_ROW}
  union all select symbol, us, 'escalate', tier from ra where tier > before and raised > (place >= {IN_ROW})::int
  union all select symbol, max(us) + {QUIET}, 'release', max(tier) from ra group by symbol, alarm having max(raised) > 0)
select symbol, us, action, tier from ev {due}"""


@query(actions_sql())
def stateful_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Alarms of each symbol's prices: raised by breaches in a row, escalated by tier, released after quiet hours."""
    return rules.actions(market.ticks(spark, folder), ["symbol"], "us", "trade_id", "price", TIERS, IN_ROW, QUIET)


@query(actions_sql(f"max(us) // 1000 * 1000 - {LATENESS * HOUR * US}"))
def streaming_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The same alarms as state of a stream with timers, as far as its watermark comes."""
    out, before = shared_folder(spark, "streaming-rules"), spark.conf.get(streams.ROCKS[0])
    spark.conf.set(*streams.ROCKS)
    try:
        rows = streams.in_order(market.ticks(spark, folder).select("symbol", "ts", "price", F.col("trade_id").alias("tie")), "ts", f"{out}/in")
        ended(stream_rules.actions(rows, "price", TIERS, IN_ROW, QUIET, f"{LATENESS} hour").writeStream.foreachBatch(streams.versions(f"{out}/actions")), out)
    finally:
        spark.conf.set(streams.ROCKS[0], before)
    return spark.read.parquet(f"{out}/actions").drop("batch")


@query("select user_id, max(epoch_us(ts)) as us, round(arg_max(value, (epoch_us(ts), event_id)), 6) as price, arg_max(event_id, (epoch_us(ts), event_id)) as trade_id from events group by 1")
def online_features(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last value, kept online from a stream of eight files, a file a micro-batch, compacted every third."""
    out = shared_folder(spark, "online-features")
    rows = market.ticks(spark, folder).select("us", "price", "trade_id").join(market.table(spark, folder, "events").select(F.col("event_id").alias("trade_id"), "user_id"), "trade_id")
    rows.repartition(8, "trade_id").write.parquet(f"{out}/in")
    table = online.OnlineTable(f"{out}/table", ["user_id"], ["us", "trade_id"], every=3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    ended(stream.writeStream.foreachBatch(table), out)
    return table.read(spark).select("user_id", "us", "price", "trade_id")


@query(f"with {TICKS} select trade_id, round((price - avg(price) over ()) / stddev_samp(price) over (), 6) as price, round((quantity - avg(quantity) over ()) / stddev_samp(quantity) over (), 6) as quantity from ticks")
def streaming_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Prices and sizes of a stream scaled by the statistics so far; the table is one file, so one micro-batch."""
    out = shared_folder(spark, "streaming-scaled")
    scale, write = streams.RunningScale(f"{out}/statistics", ["price", "quantity"]), streams.versions(f"{out}/scaled")
    ended(streamed_ticks(spark, folder).writeStream.foreachBatch(lambda batch, number: write(scale(batch, number), number)), out)
    return spark.read.parquet(f"{out}/scaled").select("trade_id", "price", "quantity")


HOURS = f"with {TICKS} select strftime(make_timestamp(us), '%Y%m%d_%H') as hour, min(us) as first_time, max(us) as last_time, count(*) as n_rows from ticks group by 1"


@query(HOURS)
def footer_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The ticks written by hours, and each hour's range from the files' footers."""
    out = shared_folder(spark, "hours")
    trades = market.ticks(spark, folder).select("trade_id", "price", "quantity", F.col("us").alias("timestamp"), F.col("ts").alias("datetime"), F.date_format(F.timestamp_micros("us"), "yyyyMMdd_HH").alias("hour"))
    market.write_hours(trades, out)
    return market.footer_ranges(spark, out).withColumn("hour", F.col("hour").cast("string"))


@query(f"{HOURS.replace('count(*) as n_rows', 'count(*) as n_rows, sum(trade_id)::bigint as ids')}")
def converted_trades(spark: SparkSession, folder: str) -> DataFrame:
    """The ticks written as four CSV files of trades, these converted chunk by chunk (two files each, or so) and read back."""
    out = shared_folder(spark, "trades")
    lines = market.ticks(spark, folder).select("trade_id", "price", "quantity", (F.col("price") * F.col("quantity")).alias("trade_value"), F.col("us").cast("string").alias("timestamp"), F.col("is_buyer_maker").cast("string").alias("maker"), F.lit("True").alias("best"))
    lines.repartition(4, "trade_id").write.csv(f"{out}/csv")
    size = sum(market._files(spark, f"{out}/csv").values())
    rows = market.convert_in_chunks(spark, f"{out}/csv", f"{out}/trades", size * 6 // 10)
    return rows.groupBy("hour").agg(F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.count("*").alias("n_rows"), F.sum("trade_id").alias("ids"))


FILL = 1.0


@query(f"""with {STATES}, q as (select symbol, row_number() over (partition by symbol order by seq) - 1 as k, seq, best_bid, best_ask from bk),
l as (select symbol, k, seq, unnest([struct_pack(side := 'buy', price := best_bid - {FILL}), struct_pack(side := 'sell', price := best_ask + {FILL})], recursive := true) from q)
select symbol, seq, side, round(price, 6) as price, (select min(x.seq) from q x where x.symbol = l.symbol and x.k > l.k and case side when 'buy' then x.best_ask <= price else x.best_bid >= price end) as reached from l where price is not null""")
def first_crossings(spark: SparkSession, folder: str) -> DataFrame:
    """After every message a buy limit below the best bid and a sell limit above the best ask, and the first later message whose opposite best reaches it."""
    states = stored(book.states(messages(spark, folder)).select("symbol", "seq", "best_bid", "best_ask"), "states")
    found = stored(chains.numbered(states, ["symbol"], ["seq"], "seq", 1_000_000, "k"), "states")
    sides = F.array(F.struct(F.lit("buy").alias("side"), (F.col("best_bid") - FILL).alias("price")), F.struct(F.lit("sell").alias("side"), (F.col("best_ask") + FILL).alias("price")))
    limits = found.select("symbol", "seq", (F.col("k") + 1).alias("since"), F.explode(sides).alias("l")).select("symbol", "seq", "since", "l.*").where("price is not null")
    met = crossing.first_reach(limits, found, ["symbol"], ["seq", "side"], "since", "k", "hit")
    named = met.join(found.select("symbol", F.col("k").alias("hit"), F.col("seq").alias("reached")), ["symbol", "hit"], "left")
    return limits.join(named, ["symbol", "seq", "side"]).select("symbol", "seq", "side", "price", "reached")


@query(elapsed_sql(False))
def elapsed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of six hours from their first tick on; the first tick after that begins the next."""
    return in_sessions(spark, folder, False)


@query(elapsed_sql(True))
def elapsed_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """The same, each with the tick that ended it."""
    return in_sessions(spark, folder, True)


@query(f"with {STATES} select symbol, seq, us, {r('best_bid', 'best_ask', 'mid', 'bid_depth', 'ask_depth')} from bk")
def streaming_books(spark: SparkSession, folder: str) -> DataFrame:
    """Book states from a stream of messages, with the levels as map state."""
    out, before = shared_folder(spark, "streaming-books"), spark.conf.get(streams.ROCKS[0])
    spark.conf.set(*streams.ROCKS)
    try:
        stream = streams.in_order(market.table(spark, folder, "events"), "event_id", f"{out}/in")
        ended(streams.books(as_messages(stream)).writeStream.foreachBatch(streams.versions(f"{out}/books")), out)
    finally:
        spark.conf.set(streams.ROCKS[0], before)
    return spark.read.parquet(f"{out}/books").drop("batch")


@query(f"""with {TICKS}, {bars_sql()}, t as (select trade_id, symbol, us, us - {HOUR * US} as seen from ticks)
select trade_id, t.symbol, round(close, 6) as last_close from t asof left join bars on bars.symbol = t.symbol and bars.bucket <= t.seen""")
def point_in_time(spark: SparkSession, folder: str) -> DataFrame:
    """Each tick with the close of the last bar that had ended by then."""
    rows = market.ticks(spark, folder).select("trade_id", "symbol", (F.col("us") - HOUR * US).alias("us"))
    stored = bars(spark, folder).select("symbol", F.col("bucket").alias("us"), "close", F.col("bucket").alias("tie"))
    return asof.backward(rows, stored, ["symbol"], "us", "close", "tie", "last_close").select("trade_id", "symbol", "last_close")


@query("select event_id, case when cast('0x' || substr(md5(event_id || '|42'), 1, 8) as bigint) / 4294967296 < 0.6 then 'train' when cast('0x' || substr(md5(event_id || '|42'), 1, 8) as bigint) / 4294967296 < 0.8 then 'valid' else 'test' end as part from events")
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    return features.split_at_random(market.table(spark, folder, "events"), "event_id", {"train": 0.6, "valid": 0.2, "test": 0.2}).select("event_id", "part")


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1 order by n desc, user_id limit 20", digits=4)
def top_users(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most active users: a top-k report."""
    return market.table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).orderBy(F.desc("n"), "user_id").limit(20)
