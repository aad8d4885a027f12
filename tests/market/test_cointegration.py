import numpy as np
import pytest

from tidemark.operators import cointegration

RNG = np.random.default_rng(5)


def walk(n):
    return np.cumsum(RNG.standard_normal(n))


@pytest.fixture(scope="module")
def made():
    """Pairs of known kinds: y and x by name."""
    n = 600
    noise = lambda: RNG.standard_normal(n)
    x = walk(n)
    pairs = {"bound": (2 * x + noise(), x), "apart": (walk(n), walk(n)), "still": (noise(), noise())}
    driver = noise()
    pairs["driven"] = (np.concatenate([[0], 0.8 * driver[:-1]]) + 0.3 * noise(), driver)
    return pairs


@pytest.fixture(scope="module")
def table(spark, made):
    return spark.createDataFrame([(k, i, float(y), float(x)) for k, (ys, xs) in made.items() for i, (y, x) in enumerate(zip(ys, xs, strict=True))], "k string, t long, y double, x double").repartition(3)


def regress(y, xs):
    """(coefficients, residual squares, standard errors) of y on xs and a constant."""
    a = np.column_stack([*xs, np.ones(len(y))])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    rss = float(((y - a @ b) ** 2).sum())
    return b, rss, np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rss / (len(y) - a.shape[1]))


def lags_of(v, p):
    """level before, lagged changes 1..p, change, on rows that have all."""
    d = np.diff(v)
    return v[p:-1], [d[p - k : len(d) - k] for k in range(1, p + 1)], d[p:]


def plain_unit_root(v, p):
    level, lagged, d = lags_of(v, p)
    best = None
    for m in range(p + 1):
        b, rss, se = regress(d, [level, *lagged[:m]])
        criterion = len(d) * np.log(rss / len(d)) + 2 * (m + 2)
        if best is None or criterion < best[0]:
            best = (criterion, m, b[0], b[0] / se[0])
    return best[1:]


def plain_eigen(series, p):
    parts = [lags_of(v, p) for v in series]
    lagged = [c for _, ls, _ in parts for c in ls]
    rest = lambda c: c - np.column_stack([*lagged, np.ones(len(c))]) @ np.linalg.lstsq(np.column_stack([*lagged, np.ones(len(c))]), c, rcond=None)[0]
    r0, r1 = np.column_stack([rest(d) for *_, d in parts]), np.column_stack([rest(v) for v, *_ in parts])
    m = np.linalg.inv(r1.T @ r1) @ (r1.T @ r0) @ np.linalg.inv(r0.T @ r0) @ (r0.T @ r1)
    values, vectors = np.linalg.eig(m)
    o = np.argsort(-values.real)
    beta = vectors.real[:, o[0]] / vectors.real[0, o[0]]
    return values.real[o], beta, (r0.T @ r1 @ beta) / (beta @ r1.T @ r1 @ beta), parts


def test_unit_roots(made, table):
    got = {r["k"]: r for r in cointegration.augmented_unit_root(table, ["k"], ["t"], "y", 3).collect()}
    for k, (y, _) in made.items():
        m, slope, t = plain_unit_root(y, 3)
        assert got[k]["lag"] == m and got[k]["n"] == len(y) - 4
        np.testing.assert_allclose([got[k]["slope"], got[k]["t"]], [slope, t], rtol=1e-8)
    assert not got["apart"]["stationary"] and got["still"]["stationary"]
    np.testing.assert_allclose(cointegration.unit_root_value(np.array([100.0])), [-2.8909], atol=1e-3)  # as tables have it


def test_eigenvalues_by_hand():
    """Two series without lags: s11 = s00 = identity, s01 diagonal, so that the eigenvalues are the squares of its cells."""
    s = np.array([[1, 0, 0.5, 0], [0, 1, 0, 0.3], [0.5, 0, 1, 0], [0, 0.3, 0, 1.0]])
    values, vectors, _, _ = cointegration.eigen(s[None], 2, [])
    np.testing.assert_allclose(values, [[0.25, 0.09]])
    np.testing.assert_allclose(np.abs(vectors[0, :, 0]), [1, 0], atol=1e-12)
    traces, rank = cointegration.trace_test(np.array([100.0]), values)
    np.testing.assert_allclose(traces, [[-100 * (np.log(0.75) + np.log(0.91)), -100 * np.log(0.91)]])
    assert rank.tolist() == [2]


def test_three_series(spark):
    n = 500
    a, b = walk(n), walk(n)
    c = a - b + RNG.standard_normal(n)
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(zip(a, b, c, strict=True))], "k int, t long, a double, b double, c double")
    r = cointegration.johansen(df, ["k"], ["t"], ["a", "b", "c"], 2).first()
    values, beta, _, _ = plain_eigen([a, b, c], 2)
    np.testing.assert_allclose(r["eigenvalues"], values, rtol=1e-7)
    np.testing.assert_allclose(r["beta"], beta, rtol=1e-6)
    assert r["rank"] == 1
    np.testing.assert_allclose(r["beta"], [1, -1, -1], atol=0.1)


def test_influence_takes_the_model_that_fits(made, table):
    got = {r["k"]: r for r in cointegration.influence(table, ["k"], ["t"], "y", "x", 2).collect()}
    assert {k: r["model"] for k, r in got.items()} == {"bound": "error correction", "apart": "changes", "still": "levels", "driven": "levels"}
    for k, (y, x) in made.items():
        r = got[k]
        values, beta, alpha, parts = plain_eigen([y, x], 2)
        np.testing.assert_allclose([r["beta"], r["alpha_y"], r["alpha_x"]], [beta[1], *alpha], rtol=1e-6)
        np.testing.assert_allclose([r["trace_none"], r["trace_one"]], [-r["n"] * np.log(1 - values).sum(), -r["n"] * np.log(1 - values[1])], rtol=1e-6)
        (yl, dy, d), (xl, dx, _) = parts
        few, full = {
            "levels": ([yl, dy[0]], [yl, dy[0], xl, dx[0]]),
            "error correction": (dy, [*dy, *dx, yl + beta[1] * xl]),
            "changes": (dy, [*dy, *dx]),
        }[r["model"]]
        dropped, left = len(full) - len(few), len(d) - len(full) - 1
        f = (regress(d, few)[1] - regress(d, full)[1]) / dropped / (regress(d, full)[1] / left)
        np.testing.assert_allclose(r["f"], f, rtol=1e-6)
        assert (r["df1"], r["df2"]) == (dropped, left)
    assert got["driven"]["f"] > 100 > 10 > got["apart"]["f"]
    np.testing.assert_allclose(got["bound"]["beta"], -2, atol=0.05)


def test_short_and_flat_series(spark):
    rows = [("flat", i, 1.0, 1.0) for i in range(20)] + [("short", i, float(i), 2.0 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, y double, x double")
    assert {r["k"] for r in cointegration.influence(df, ["k"], ["t"], "y", "x", 2).collect()} == {"flat"}
    assert cointegration.augmented_unit_root(df.where("false"), ["k"], ["t"], "y").count() == 0
