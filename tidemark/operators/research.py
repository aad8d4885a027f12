"""Growth-optimal fractions, regressions and tests, stability of figures over time, anomalies, drift and risk limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series


def kelly(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Fraction mean / (variance + mean^2) of independent returns, and its approximation mean / variance."""
    out = df.groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.var_pop(ret).alias("variance"))
    return out.withColumns({"kelly": series.safe_div(F.col("mean"), F.col("variance") + F.col("mean") ** 2), "kelly_approx": series.safe_div(F.col("mean"), F.col("variance"))})


def lagged_pairs(df: DataFrame, keys: list[str], order: list[str], ret: str) -> DataFrame:
    return df.withColumn("before", F.lag(ret).over(series.ordered(keys, order)))


def ar1(df: DataFrame, keys: list[str], order: list[str], ret: str) -> DataFrame:
    """AR(1): rho, mean, total and residual variance of each series' returns, and the naive over the informed leverage."""
    pairs = lagged_pairs(df, keys, order, ret).where(F.col("before").isNotNull() & F.col(ret).isNotNull())
    fit = pairs.groupBy(*keys).agg(F.regr_slope(ret, "before").alias("rho"), F.regr_intercept(ret, "before").alias("intercept"), F.var_pop(ret).alias("variance"), F.regr_r2(ret, "before").alias("r2"), F.count("*").alias("n"))
    out = fit.withColumns({"mu": series.safe_div(F.col("intercept"), 1 - F.col("rho")), "residual": F.col("variance") * (1 - F.col("r2"))})
    return out.select(*keys, "n", "rho", "mu", "variance", "residual", (1 - F.col("rho") ** 2).alias("risk_share"))


def conditional_kelly(df: DataFrame, keys: list[str], order: list[str], ret: str) -> DataFrame:
    """Adds the conditional mean m = mu + rho (previous - mu), and the fractions m / (residual + m^2) and m / residual.

    The fitted series, a row a key, are joined back; keys with many rows are split by adaptive execution."""
    pairs = lagged_pairs(df, keys, order, ret).join(ar1(df, keys, order, ret).drop("n"), keys)
    m = F.col("mu") + F.col("rho") * (F.col("before") - F.col("mu"))
    return pairs.withColumn("m", m).withColumns({"kelly": series.safe_div(F.col("m"), F.col("residual") + F.col("m") ** 2), "kelly_approx": series.safe_div(F.col("m"), F.col("residual"))}).drop("mu", "rho", "variance", "residual", "risk_share")


def least_squares(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Residual sum of squares of y on xs and a constant, by key: normal equations of centred columns, solved by elimination.

    The moments combine before the shuffle; the solving is a projection of a row a key."""
    names = [*xs, y]
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names]))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(moment.alias(name) for name, moment in _moments(names).items()))
    k = len(xs)
    at = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    for p in range(k):  # each step takes one regressor out of the rest: the last cell becomes the residual
        out = out.withColumns({f"_s{i}_{j}": at(i, j) - F.coalesce(series.safe_div(at(p, i) * at(p, j), at(p, p)), F.lit(0.0)) for i in range(p + 1, k + 1) for j in range(i, k + 1)})
    return out.select(*keys, "n", F.greatest(at(k, k), F.lit(0.0)).alias("rss"))


def _moments(names: list[str]) -> dict[str, Column]:
    """Sums of products of every two columns about their means, found in one pass without large sums."""
    return {f"_s{i}_{j}": F.covar_pop(a, b) * F.count("*") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}


def f_test(restricted: DataFrame, full: DataFrame, keys: list[str], dropped: int, parameters: int) -> DataFrame:
    """F statistic of ``dropped`` coefficients being zero, with its degrees of freedom."""
    both = full.withColumnRenamed("rss", "rss_full").join(restricted.select(*keys, F.col("rss").alias("rss_restricted")), keys)
    f = series.safe_div((F.col("rss_restricted") - F.col("rss_full")) / dropped, F.col("rss_full") / (F.col("n") - parameters))
    return both.select(*keys, "n", f.alias("f"), F.lit(dropped).alias("df1"), (F.col("n") - parameters).alias("df2"))


def granger(df: DataFrame, keys: list[str], order: list[str], y: str, x: str, lags: int = 2) -> DataFrame:
    """F test by key that x's lags add nothing to y's own lags."""
    w = series.ordered(keys, order)
    own, other = [f"_y{k}" for k in range(1, lags + 1)], [f"_x{k}" for k in range(1, lags + 1)]
    rows = df.withColumns({f"_y{k}": F.lag(y, k).over(w) for k in range(1, lags + 1)} | {f"_x{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)}).where(F.col(other[-1]).isNotNull() & F.col(own[-1]).isNotNull())
    return f_test(least_squares(rows, keys, y, own), least_squares(rows, keys, y, own + other), keys, lags, 2 * lags + 1)


def unit_root(df: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """Dickey-Fuller regression of the change on the level: slope and its t statistic by key."""
    w = series.ordered(keys, order)
    rows = df.withColumn("_before", F.lag(y).over(w)).withColumn("_d", F.col(y) - F.col("_before")).where("_before is not null")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_d", "_before").alias("slope"), F.regr_sxx("_d", "_before").alias("sxx"), F.regr_syy("_d", "_before").alias("syy"), F.regr_sxy("_d", "_before").alias("sxy"))
    variance = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    return out.select(*keys, "n", "slope", series.safe_div(F.col("slope"), F.sqrt(series.safe_div(F.greatest(variance, F.lit(0.0)), F.col("sxx")))).alias("t"))


def vector_regression(df: DataFrame, keys: list[str], order: list[str], a: str, b: str) -> DataFrame:
    """VAR(1) of two series by key: each on a constant and both series' values before. Coefficients x_y (of y's value before in x's equation),
    constants and residual variances."""
    w = series.ordered(keys, order)
    names = ["_a0", "_b0", a, b]
    rows = df.withColumns({"_a0": F.lag(a).over(w), "_b0": F.lag(b).over(w)}).where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names]))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(m.alias(n) for n, m in _moments(names).items()), *(F.avg(c).alias(f"_m{k}") for k, c in enumerate(names)))
    det = F.col("_s0_0") * F.col("_s1_1") - F.col("_s0_1") * F.col("_s0_1")
    for place, name in ((2, "a"), (3, "b")):
        p, q = F.col(f"_s0_{place}"), F.col(f"_s1_{place}")
        out = out.withColumns({f"{name}_a": series.safe_div(p * F.col("_s1_1") - q * F.col("_s0_1"), det), f"{name}_b": series.safe_div(q * F.col("_s0_0") - p * F.col("_s0_1"), det)})
        out = out.withColumns({f"{name}_const": F.col(f"_m{place}") - F.col(f"{name}_a") * F.col("_m0") - F.col(f"{name}_b") * F.col("_m1"), f"{name}_variance": (F.col(f"_s{place}_{place}") - F.col(f"{name}_a") * p - F.col(f"{name}_b") * q) / (F.col("n") - 3)})
    return out.select(*keys, "n", *(f"{x}_{c}" for x in "ab" for c in ("a", "b", "const", "variance")))


def johansen(df: DataFrame, keys: list[str], order: list[str], a: str, b: str) -> DataFrame:
    """Johansen's test of two series by key (a constant, no lagged changes): both eigenvalues and the trace statistics of at most none and at most one
    cointegrating relation. With two series the eigenvalues follow from a quadratic equation in the moments."""
    w = series.ordered(keys, order)
    names = ["_da", "_db", "_a0", "_b0"]
    rows = df.withColumns({"_a0": F.lag(a).over(w), "_b0": F.lag(b).over(w)}).withColumns({"_da": F.col(a) - F.col("_a0"), "_db": F.col(b) - F.col("_b0")})
    rows = rows.where(F.col("_da").isNotNull() & F.col("_db").isNotNull())
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(m.alias(n) for n, m in _moments(names).items()))
    at = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    det0, det1 = at(0, 0) * at(1, 1) - at(0, 1) * at(0, 1), at(2, 2) * at(3, 3) - at(2, 3) * at(2, 3)
    # m = s11^-1 s10 s00^-1 s01, by its cells
    s = s.withColumns({f"_i{i}{j}": series.safe_div(c, det0) for (i, j), c in {(0, 0): at(1, 1), (0, 1): -at(0, 1), (1, 1): at(0, 0)}.items()} | {f"_k{i}{j}": series.safe_div(c, det1) for (i, j), c in {(0, 0): at(3, 3), (0, 1): -at(2, 3), (1, 1): at(2, 2)}.items()})
    inner = lambda i, j: sum((at(x, 2 + i) * F.col(f"_i{min(x, y)}{max(x, y)}") * at(y, 2 + j) for x in (0, 1) for y in (0, 1)), F.lit(0.0))
    s = s.withColumns({f"_q{i}{j}": inner(i, j) for i in (0, 1) for j in (0, 1)})
    cell = lambda i, j: sum((F.col(f"_k{min(i, x)}{max(i, x)}") * F.col(f"_q{x}{j}") for x in (0, 1)), F.lit(0.0))
    s = s.withColumns({"_t": cell(0, 0) + cell(1, 1), "_d": cell(0, 0) * cell(1, 1) - cell(0, 1) * cell(1, 0)})
    root = F.sqrt(F.greatest(F.col("_t") * F.col("_t") / 4 - F.col("_d"), F.lit(0.0)))
    s = s.withColumns({"lambda1": F.col("_t") / 2 + root, "lambda2": F.col("_t") / 2 - root})
    trace = lambda *ls: -F.col("n") * sum((F.ln(1 - F.col(x)) for x in ls), F.lit(0.0))
    return s.select(*keys, "n", "lambda1", "lambda2", trace("lambda1", "lambda2").alias("trace_none"), trace("lambda2").alias("trace_one"))


def chow(df: DataFrame, keys: list[str], y: str, x: str, late: Column) -> DataFrame:
    """F test by key that one regression of y on x serves both the rows where ``late`` holds and the rest."""
    whole, halves = least_squares(df, keys, y, [x]), least_squares(df.withColumn("_late", late), [*keys, "_late"], y, [x])
    apart = halves.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("rss").alias("rss"))
    return f_test(whole, apart, keys, 2, 4)


def folds(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Adds fold, 1 to n: contiguous parts of each series with as equal counts as can be."""
    return df.withColumn("fold", F.ntile(n).over(series.ordered(keys, order)))


def fold_figures(df: DataFrame, keys: list[str], order: list[str], ret: str, n: int) -> DataFrame:
    """Mean, deviation and Sharpe ratio of every fold next to those of all folds before it (walk-forward)."""
    # about the series' mean, so that squares stay small
    centred = folds(df, keys, order, n).join(df.groupBy(*keys).agg(F.avg(ret).alias("_m")), keys).withColumn("_d", F.col(ret) - F.col("_m"))
    per = centred.groupBy(*keys, "fold").agg(F.count(ret).alias("n"), F.sum("_d").alias("s"), F.sum(F.col("_d") * F.col("_d")).alias("q"), F.first("_m").alias("m"))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"n0": F.sum("n").over(before), "s0": F.sum("s").over(before), "q0": F.sum("q").over(before)})
    ratio = lambda c, s, q: series.safe_div(F.col("m") + series.safe_div(F.col(s), F.col(c)), F.sqrt(F.greatest(series.safe_div(F.col(q) - F.col(s) * F.col(s) / F.nullif(F.col(c), F.lit(0)), F.col(c) - 1), F.lit(0.0))))
    return per.select(*keys, "fold", "n", (F.col("m") + series.safe_div(F.col("s"), F.col("n"))).alias("mean"), ratio("n", "s", "q").alias("sharpe"), ratio("n0", "s0", "q0").alias("sharpe_before"))


def sensitivity(df: DataFrame, keys: list[str], value: str, ret: str, limits: list[float]) -> DataFrame:
    """Trades and mean return by key when a value has to exceed each limit."""
    grid = F.explode(F.array(*map(F.lit, limits))).alias("limit")
    return df.select(*keys, value, ret, grid).where(F.col(value) > F.col("limit")).groupBy(*keys, "limit").agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"))


def rolling_relations(df: DataFrame, keys: list[str], order: list[str], a: str, b: str, rows: int) -> DataFrame:
    """Adds rolling deviation and Sharpe ratio of a, and the correlation of a and b."""
    w = series.ordered(keys, order)
    frame = w.rowsBetween(-(rows - 1), 0)
    full = F.count(a).over(frame) >= rows
    return df.withColumns({"roll_sd": series.rolling(F.stddev_samp, a, w, rows), "roll_sharpe": series.safe_div(series.rolling(F.avg, a, w, rows), series.rolling(F.stddev_samp, a, w, rows)), "roll_corr": F.when(full, series.safe_div(F.covar_samp(a, b).over(frame), F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)))})


def anomalies(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, limit: float) -> DataFrame:
    """Adds z against the ``rows`` rows before, and whether it exceeds the limit either way."""
    before = series.ordered(keys, order).rowsBetween(-rows, -1)
    z = F.when(F.count(value).over(before) >= rows, series.safe_div(F.col(value) - F.avg(value).over(before), F.stddev_samp(value).over(before)))
    return df.withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def drift(reference: DataFrame, current: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """One row, psi: population stability index of two tables' values in equal bins of [low, high], ends open."""
    place = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias(name))
    every = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = every.join(counted(reference, "a"), "bin", "left").join(counted(current, "b"), "bin", "left").fillna(0)
    sums = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    pa, pb = (F.col("a") + 0.5) / (F.col("na") + 0.5 * bins), (F.col("b") + 0.5) / (F.col("nb") + 0.5 * bins)
    return both.join(F.broadcast(sums)).agg(F.sum((pa - pb) * F.ln(pa / pb)).alias("psi"))


def repriced(trades: DataFrame, basis_points: float) -> DataFrame:
    """Trades with pnl_net, the round trip's cost taken off."""
    return trades.withColumn("pnl_net", F.col("pnl_pct") - basis_points / 10_000)


def lookahead(df: DataFrame, data_time: str, decision_time: str) -> DataFrame:
    """Rows that use data later than their decision."""
    return df.where(F.col(data_time) > F.col(decision_time))


def risk_levels(df: DataFrame, keys: list[str], order: list[str], ret: str, rows: int, target: float, cap: float, limits: tuple[float, float, float]) -> DataFrame:
    """Adds leverage (target over rolling deviation, capped), drawdown of the summed returns, and tier 0 to 3 by drawdown limits;
    tier 3 closes the position."""
    w = series.ordered(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sd = series.rolling(F.stddev_samp, ret, w, rows)
    df = df.withColumns({"leverage": F.least(F.coalesce(series.safe_div(F.lit(target), sd), F.lit(cap)), F.lit(cap)), "equity": F.sum(F.coalesce(F.col(ret), F.lit(0.0))).over(so_far)})
    df = df.withColumn("drawdown", F.greatest(F.max("equity").over(so_far), F.lit(0.0)) - F.col("equity"))
    tier = F.when(F.col("drawdown") >= limits[2], 3).when(F.col("drawdown") >= limits[1], 2).when(F.col("drawdown") >= limits[0], 1).otherwise(0)
    return df.withColumn("tier", tier).withColumn("leverage", F.when(F.col("tier") == 3, 0.0).otherwise(F.col("leverage")))
