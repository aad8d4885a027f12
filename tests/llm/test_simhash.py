import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import components as cc
from tidemark.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def expected(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_roots({f for _, f in fps})
    smallest = {}
    for i, f in fps:
        smallest[roots[f]] = min(i, smallest.get(roots[f], i))
    return sorted((i, f"{f:016x}", smallest[roots[f]]) for i, f in fps)


def result(df):
    return sorted(tuple(r) for r in simhash.near_duplicates(df).collect())


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_edge_cases(spark):
    rows = [(5, None, 1), (3, "", 1), (4, "  \n\t", 1), (7, "One", 1), (8, "one", 2), (9, "a b", 1), (1, "A  B", 1), (10, " x y z", 1), (10, " x y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert result(df) == expected([(i, t) for i, t, _ in rows])
    assert result(df.where("false")) == []


def test_long_text_in_steps(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["x", "yy", "zzz", "Ä"]) for _ in range(5000))
    whole = plain_fingerprint(text)
    assert simhash.fingerprint(text.encode()) == whole
    monkeypatch.setattr(simhash.at, "SLICE_BYTES", 1000)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text.encode()) == whole


LAYOUTS = [None, [(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(0, 64, 2)), 2)], [(list(range(k, 64, 3)), 0) for k in range(3)]]


@pytest.mark.parametrize(("block", "layout"), [(1, 0), (4, 1), (1000, 1), (1000, 2), (4, 3)])
def test_links_in_blocks_of_any_size(spark, monkeypatch, block, layout):
    monkeypatch.setattr(simhash, "BLOCK", block)
    if layout:
        monkeypatch.setattr(simhash, "layout", lambda sample, total, distance=2: LAYOUTS[layout])
    rng = random.Random(block)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            fps.add(centre)
            for _ in range(rng.choice([1, 2, 2, 3])):
                centre ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"]: r["root"] for r in cc.components(simhash.links(distinct)).collect()}
    ours, brute = {}, {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        ours.setdefault(found.get(s, s), set()).add(f)
    for f, r in plain_roots(fps).items():
        brute.setdefault(r, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, brute.values()))


@pytest.mark.parametrize("total", [1000, 10**7, 10**11])
def test_layout_covers_the_distance(total):
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    parts = simhash.layout(sample, total)
    assert sum(t + 1 for _, t in parts) == simhash.DISTANCE + 1
    used = [b for bits, _ in parts for b in bits]
    assert len(used) == len(set(used))
