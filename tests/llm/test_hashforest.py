import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hashforest

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=5, every=50):
    """Every sound row compared with every query; (query_id, vec_id, score) by rank."""
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            near = sorted((-float(x @ q / np.sqrt((x @ x) * (q @ q))), j if j is not None else 1 << 62) for b, (j, x) in enumerate(ok) if a != b and len(x) == len(q))
            out.append((i, near[:k]))
    return out


def compare(rows, got):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    expected = plain(rows)
    assert set(found) <= {i for i, _ in expected}
    for i, near in expected:
        mine = sorted(found.get(i, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(near) + 1))
        assert [r["vec_id"] if r["vec_id"] is not None else 1 << 62 for r in mine] == [j for _, j in near]
        np.testing.assert_allclose([r["score"] for r in mine], [-s for s, _ in near], rtol=0, atol=1e-14)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0]), (350, [1.0, 2.0, 3.0]), (400, [2.0, 0.0]), (7, [3.0, 0.0]), (3, [1.0, 0.0]), (9, [-1.0, 0.0]), (11, [0.0, 1.0]), (13, [0.5, 1.0])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = hashforest.nearest(docs).collect()
    compare([r for r in rows if r[0] != 350], [r for r in got if r["query_id"] != 350])
    assert not [r for r in got if r["query_id"] == 350]  # alone with its length
    clash = docs.withColumns({c: F.lit("clash") for c in ("row", "length", "vector", "rank", "score", "block", "level", "query")})
    assert sorted(map(str, hashforest.nearest(clash).collect())) == sorted(map(str, got))
    assert hashforest.nearest(docs.where("false")).count() == 0


def test_great_and_small_components(spark):
    rows = [(0, [1e200, 1e-200]), (1, [1e180, 0.0]), (2, [1e-300, 1e-300]), (3, [-1e250, 1e250])]
    got = hashforest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3]
    np.testing.assert_allclose([r["score"] for r in got], [1, 2**-0.5, -(2**-0.5)], atol=1e-14)


def test_copies_go_by_id(spark):
    rng = np.random.default_rng(1)
    copies, others = rng.standard_normal(16), rng.standard_normal((800, 16))
    rows = [(k, copies.tolist()) for k in range(700)] + [(1000 + k, v.tolist()) for k, v in enumerate(others)] + [(50, copies.tolist())]
    got = hashforest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).where("query_id < 700").collect()
    for q in (0, 100, 650):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in range(6) if i != q][:5]
    assert len([r for r in got if r["query_id"] == 50]) == 10  # two rows, two searches


@pytest.mark.parametrize("block", [1 << 15, 300])
def test_recall_on_the_table(spark, monkeypatch, block):
    """In few blocks and in many, with queries in several groups."""
    monkeypatch.setattr(hashforest, "BLOCK", block)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    every = 50 if block > 1000 else 5
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in hashforest.nearest(table, every=every).collect()}
    truth = {(i, j) for i, near in plain(rows, every=every) for _, j in near} if every == 50 else None
    if truth:
        assert len(got) == len(truth) and len(got & truth) >= 0.9 * len(truth)
    else:
        e = np.array([v for _, v in rows], float)
        e /= np.linalg.norm(e, axis=1)[:, None]
        ids = np.array([i for i, _ in rows])
        q = np.flatnonzero(ids % every == 0)
        s = e[q] @ e.T
        s[np.arange(len(q)), q] = -2
        near = np.argsort(-s, axis=1)[:, :5]
        truth = {(ids[a], ids[b]) for a, bs in zip(q, near, strict=True) for b in bs}
        assert len(got) == len(truth) and len(got & truth) >= 0.9 * len(truth)
