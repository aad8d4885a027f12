"""Unit roots, cointegration and the test of one series' influence on another, with lagged changes.

Every figure follows from sums of products of levels, changes and lagged changes about their means. These are found in one pass over the rows and
combine before the shuffle; what is left is a small matrix a key, of which numpy solves many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series

#: MacKinnon's response surface of the Dickey-Fuller t statistic with a constant, by level: coefficients of 1, 1/n, 1/n^2 and 1/n^3.
UNIT_ROOT_SURFACE = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: Critical values of the trace statistic with a constant, for 1 to 5 series less relations, by level.
TRACE_VALUES = {0.10: (2.7055, 13.4294, 27.0669, 44.4929, 65.8202), 0.05: (3.8415, 15.4943, 29.7961, 47.8545, 69.8189), 0.01: (6.6349, 19.9349, 35.4628, 54.6815, 77.8202)}


def unit_root_value(n: np.ndarray, level: float = 0.05) -> np.ndarray:
    """The value below which the t statistic of n rows rejects a unit root."""
    return sum(c / np.asarray(n, float) ** k for k, c in enumerate(UNIT_ROOT_SURFACE[level]))


def lag_columns(df: DataFrame, keys: list[str], order: list[str], names: list[str], lags: int) -> tuple[DataFrame, list[str]]:
    """Rows with every column of a regression: for each series its change, its level before, and its changes 1 to ``lags`` rows before."""
    w = series.ordered(keys, order)
    before = df.withColumns({f"_l{i}": F.lag(c).over(w) for i, c in enumerate(names)})
    change = before.withColumns({f"_d{i}": F.col(c) - F.col(f"_l{i}") for i, c in enumerate(names)})
    lagged = change.withColumns({f"_d{i}_{k}": F.lag(f"_d{i}", k).over(w) for i in range(len(names)) for k in range(1, lags + 1)})
    columns = [f"_l{i}" for i in range(len(names))] + [f"_d{i}_{k}" for i in range(len(names)) for k in range(1, lags + 1)] + [f"_d{i}" for i in range(len(names))]
    return lagged.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])), columns


def moments(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, s: the sums of products of every two columns about their means, row by row."""
    size = len(columns)
    cell = {(i, j): F.covar_pop(columns[i], columns[j]) * F.count("*") for i in range(size) for j in range(i, size)}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(cell[min(i, j), max(i, j)] for i in range(size) for j in range(size))).alias("s"))


def swept(s: np.ndarray, out: list[int]) -> np.ndarray:
    """Matrices (keys, m, m) after the columns ``out`` are regressed out of the rest, one after the other; a column without a remainder takes nothing out."""
    s = s.copy()
    scale = np.abs(np.diagonal(s, axis1=1, axis2=2)).copy()
    for p in out:
        pivot = s[:, p, p]
        sound = pivot > 1e-12 * scale[:, p]
        factor = np.where(sound[:, None], s[:, p, :] / np.where(sound, pivot, 1.0)[:, None], 0.0)
        s = s - s[:, :, p][:, :, None] * factor[:, None, :]
    return s


def _solved(df: DataFrame, keys: list[str], fields: str, solve) -> DataFrame:
    """A row a key through ``solve``(n, matrices) -> columns."""
    names = [f.split()[0] for f in fields.split(", ")]
    types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def body(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                s = np.array(frame["s"].tolist(), float)
                size = round(s.shape[1] ** 0.5)
                with np.errstate(all="ignore"):
                    got = solve(frame["n"].to_numpy(float), s.reshape(-1, size, size))
                yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(dict(zip(names, got, strict=True)))], axis=1)

    return df.mapInPandas(body, f"{types}, {fields}")


def _unit_root(n: np.ndarray, s: np.ndarray, level: int, lagged: list[int], change: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lags with the least Akaike criterion, slope, t) of the change on the level and none, one or more of the lagged changes."""
    best = (np.zeros(len(n), int), np.full(len(n), np.nan), np.full(len(n), np.nan), np.full(len(n), np.inf))
    for p in range(len(lagged) + 1):
        left = swept(s, lagged[:p])
        slope = left[:, level, change] / left[:, level, level]
        rest = left[:, change, change] - slope * left[:, level, change]
        t = slope / np.sqrt(np.maximum(rest, 0) / (n - p - 2) / left[:, level, level])
        criterion = n * np.log(rest / n) + 2 * (p + 2)
        better = criterion < best[3] - 1e-9 * np.abs(criterion)
        best = tuple(np.where(better, a, b) for a, b in zip((np.full(len(n), p), slope, t, criterion), best, strict=True))
    return best[:3]


def augmented_unit_root(df: DataFrame, keys: list[str], order: list[str], y: str, lags: int = 4, level: float = 0.05) -> DataFrame:
    """keys, n, lag, slope, t, critical, stationary: the Dickey-Fuller regression of y's change on its level, a constant and as many of its ``lags`` changes
    before as Akaike's criterion takes, all compared on the same rows."""
    rows, columns = lag_columns(df, keys, order, [y], lags)

    def solve(n, s):
        lag, slope, t = _unit_root(n, s, 0, list(range(1, lags + 1)), lags + 1)
        value = unit_root_value(n, level)
        return n.astype(int), lag.astype(int), slope, t, value, t < value

    return _solved(moments(rows, keys, columns), keys, "n long, lag int, slope double, t double, critical double, stationary boolean", solve)


def eigen(s: np.ndarray, k: int, lagged: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues from the greatest, vectors as columns, s01, s11) of Johansen's problem: levels are the first k columns, changes the last k."""
    left = swept(s, lagged)
    level, change = slice(0, k), slice(s.shape[1] - k, s.shape[1])
    s00, s01, s11 = left[:, change, change], left[:, change, level], left[:, level, level]
    found = [np.linalg.eig(np.linalg.lstsq(c, b.T @ np.linalg.lstsq(a, b, rcond=None)[0], rcond=None)[0]) for a, b, c in zip(s00, s01, s11, strict=True)]
    order = [np.argsort(-v.real) for v, _ in found]
    values = np.array([np.clip(v.real[o], 0, 1 - 1e-15) for (v, _), o in zip(found, order, strict=True)])
    vectors = np.array([m.real[:, o] for (_, m), o in zip(found, order, strict=True)])
    return values, vectors, s01, s11


def trace_test(n: np.ndarray, values: np.ndarray, level: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(trace statistics of at most 0, 1, ... relations, the first number of relations that isn't rejected)."""
    k = values.shape[1]
    traces = -n[:, None] * np.cumsum(np.log1p(-values[:, ::-1]), axis=1)[:, ::-1]
    kept = traces < np.array([TRACE_VALUES[level][k - r - 1] for r in range(k)])
    return traces, np.where(kept.any(axis=1), kept.argmax(axis=1), k)


def johansen(df: DataFrame, keys: list[str], order: list[str], names: list[str], lags: int = 1, level: float = 0.05) -> DataFrame:
    """keys, n, eigenvalues, traces, rank and beta (the first relation's coefficients, that of the first series 1) of two to five series, with
    ``lags`` lagged changes and a constant."""
    k = len(names)
    rows, columns = lag_columns(df, keys, order, names, lags)

    def solve(n, s):
        values, vectors, _, _ = eigen(s, k, list(range(k, k + k * lags)))
        traces, rank = trace_test(n, values, level)
        return n.astype(int), values.tolist(), traces.tolist(), rank.astype(int), (vectors[:, :, 0] / vectors[:, :1, 0]).tolist()

    return _solved(moments(rows, keys, columns), keys, "n long, eigenvalues array<double>, traces array<double>, rank int, beta array<double>", solve)


def influence(df: DataFrame, keys: list[str], order: list[str], y: str, x: str, lags: int = 2, level: float = 0.05) -> DataFrame:
    """Whether x helps to predict y, by key, with the model that fits their kind.

    Both are tested for a unit root, then for cointegration. Without a unit root in either x's lags are tested in a regression of levels; else with a
    relation in an error-correction model, where x's lagged changes and the relation's error must all be zero; else in changes.
    Returns keys, n, lag_y, t_y, lag_x, t_x, trace_none, trace_one, rank, beta (of x, y's being 1), alpha_y, alpha_x (how fast each corrects the
    error), model ('levels', 'error correction', 'changes'), f, df1 and df2."""
    rows, columns = lag_columns(df, keys, order, [y, x], lags)
    own, other, change = [2 + k for k in range(lags)], [2 + lags + k for k in range(lags)], 2 + 2 * lags

    def solve(n, s):
        lag_y, _, t_y = _unit_root(n, s, 0, own, change)
        lag_x, _, t_x = _unit_root(n, s, 1, other, change + 1)
        values, vectors, s01, s11 = eigen(s, 2, own + other)
        traces, rank = trace_test(n, values, level)
        beta = vectors[:, :, 0] / vectors[:, :1, 0]
        alpha = np.einsum("kij,kj->ki", s01, beta) / np.einsum("ki,kij,kj->k", beta, s11, beta)[:, None]
        value = unit_root_value(n, level)
        levels = (t_y < value) & (t_x < value)
        model = np.where(levels, "levels", np.where(rank > 0, "error correction", "changes"))
        # residual squares of y's change: restricted and full, for each model; levels of ``lags`` lags are a level and lags - 1 changes
        rest = lambda out: swept(s, out)[:, change, change]
        both = swept(s, own + other)
        error = np.einsum("ki,kij,kj->k", beta, both[:, :2, :2], beta)
        met = np.einsum("ki,ki->k", beta, both[:, :2, change])
        fits = {
            "levels": (rest([0, *own[:-1]]), rest([0, *own[:-1], 1, *other[:-1]]), lags, 2 * lags + 1),
            "error correction": (rest(own), both[:, change, change] - met**2 / error, lags + 1, 2 * lags + 2),
            "changes": (rest(own), rest(own + other), lags, 2 * lags + 1),
        }
        few, full, dropped, used = (np.select([model == m for m in fits], [np.broadcast_to(f[i], n.shape) for f in fits.values()]) for i in range(4))
        f = (few - full) / dropped / (full / (n - used))
        return n.astype(int), lag_y.astype(int), t_y, lag_x.astype(int), t_x, traces[:, 0], traces[:, 1], rank.astype(int), beta[:, 1], alpha[:, 0], alpha[:, 1], model, f, dropped.astype(int), (n - used).astype(int)

    fields = "n long, lag_y int, t_y double, lag_x int, t_x double, trace_none double, trace_one double, rank int, beta double, alpha_y double, alpha_x double, model string, f double, df1 int, df2 long"
    return _solved(moments(rows, keys, columns), keys, fields, solve)
