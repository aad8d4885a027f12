import itertools
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from tidemark.llm import nearcopies as nc
from tidemark.llm import shared

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots(sets, linked):
    """The smallest doc_id of each component of the pairs that are linked."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def plain_kept(rows):
    """(what stays when all pairs at 0.8 or more are linked, what stays when only those are that some fingerprint has within DISTANCE bits)."""
    sets = {i: plain_set(t) for i, t in rows}
    hashed = {i: nc.shingles((t or "").encode()) for i, t in rows}
    prints = {i: [nc.fingerprint(h, k) for k in range(nc.SEEDS)] for i, h in hashed.items()}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)

    near = lambda a, b: sets[a] == sets[b] or min((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= nc.DISTANCE
    return roots(sets, alike), roots(sets, lambda a, b: near(a, b) and alike(a, b))


def between(ids, rows):
    fewest, most = plain_kept(rows)
    assert len(ids) == len(set(ids)) and fewest <= set(ids) <= most


def test_fingerprints():
    """The first is the plain SimHash of the shingles' XXH64; the others are of hashes mixed anew."""
    text = "one two three four five six seven eight nine ten"
    h = [xxhash.xxh64_intdigest(s, 42) for s in plain_set(text)]
    own = nc.shingles(text.encode())
    assert nc.fingerprint(own) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = [nc.fingerprint(own, k) for k in range(4)]
    assert min((a ^ b).bit_count() for a, b in itertools.combinations(prints, 2)) > 12


def copies(rng, n_families, n_copies):
    """Families of texts that were edited word by word, each from the one before."""
    rows = []
    for _ in range(n_families):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(n_copies):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([15, 40, 100]))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    return rows


@pytest.mark.parametrize("distance", [2, 5, 8])
def test_matches_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr(nc, "DISTANCE", distance)
    rows = copies(random.Random(3), 30, 12)
    rows += [(1000, None), (1001, " \n"), (1002, "One two"), (1003, "one  TWO"), (1004, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    between([r["doc_id"] for r in nc.keep_one(docs).collect()], rows)
    assert nc.keep_one(docs.where("false")).count() == 0


def test_rows_that_share_an_id_but_not_a_text(spark):
    rows = [(1, "a b c d e f g"), (1, "another text that is not like it"), (1, "a b c d e f g"), (2, "A b c d e f g")]
    assert sorted(r["text"] for r in nc.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(t for _, t in rows[:2])


def test_the_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] for r in out.collect())
    between(ids, rows)
    assert len(ids) < len(rows)


def test_recall_against_all_pairs(spark):
    """Of the pairs of different sets at 0.8 or more in a whole table, found by their common shingles, at least 0.9 are connected."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r["node"]: r["root"] for r in nc.rooted(docs).select("node", "root").distinct().collect()}
    sets = {nc.digest(h): h for r in docs.select("text").collect() if len(h := nc.shingles((r[0] or "").encode()))}
    sets = {np.uint64(k).astype(np.int64).item(): h for k, h in sets.items()}
    holders, common = defaultdict(list), Counter()
    for node, hashes in sets.items():
        for h in hashes.tolist():
            holders[h].append(node)
    for nodes in holders.values():
        common.update(itertools.combinations(sorted(nodes), 2))
    pairs = [(a, b) for (a, b), both in common.items() if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)]
    connected = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 30 and connected >= 0.9 * len(pairs), (connected, len(pairs))


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, "quite another text here", "z"), (1, "a b c d e f", "y"), (None, "a b c d e f", "n"), (None, "a b c d e f", "n")]
    kept = nc.keep_one(spark.createDataFrame(rows, "doc_id long, text string, text_hash string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f", "y"), (3, "quite another text here", "z"), (None, "a b c d e f", "n"), (None, "a b c d e f", "n")], key=str)


def test_long_text_in_steps(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["x", "yy", "zzz", "Ä"]) for _ in range(3000)).encode()
    whole = nc.shingles(text)
    assert len(whole) == len(plain_set(text.decode()))
    monkeypatch.setattr(nc.at, "SLICE_BYTES", 1000)
    monkeypatch.setattr("tidemark.llm.simhash.at.SLICE_BYTES", 1000)
    monkeypatch.setattr(nc, "STEP", 7)
    assert (nc.shingles(text) == whole).all()


def test_pairs_that_cannot_be_near_copies_are_told_by_sketches(spark):
    """No pair at 0.8 or more whose fingerprints are alike is lost, and of those well below it few are left to be compared in full."""
    rng = np.random.default_rng(8)
    own = [rng.integers(0, 1 << 63, 300).astype(np.uint64)]
    for changed in np.linspace(2, 90, 60).astype(int):
        own.append(np.concatenate([own[0][changed:], rng.integers(0, 1 << 63, changed + int(rng.integers(0, 5))).astype(np.uint64)]))
    own.append(own[0][:200])
    sets = [np.unique(s) for s in own]
    sketch = [(k, [nc.fingerprint(s, j) for j in range(nc.SEEDS)], nc.parities(s).tolist(), len(s)) for k, s in enumerate(sets)]
    signed = lambda fps: np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(k, signed(f), o, n) for k, f, o, n in sketch], "node long, fps array<long>, odd array<long>, size long")
    pairs = list(itertools.combinations(range(len(sets)), 2))
    left = {(r["a"], r["b"]) for r in nc._likely(spark.createDataFrame(pairs, "a long, b long"), nodes).collect()}
    alike = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in pairs}
    by_prints = {(a, b) for a, b in pairs if sum((x ^ y).bit_count() for x, y in zip(sketch[a][1], sketch[b][1], strict=True)) <= nc.SEEDS * nc.ALL}
    assert {p for p in by_prints if alike[p] >= 0.8} == {p for p in left if alike[p] >= 0.8}
    below = {p for p in by_prints if alike[p] < 0.7}
    assert left <= by_prints and len(below) > 50 and len(below & left) < len(below) / 10


def test_rows_are_split_without_being_dealt_out(spark, tmp_path):
    """All rows whose keys are asked for are in the first part, few others are, and those that stay are read without a shuffle."""
    spark.range(2000).selectExpr("if(id % 100 = 7, null, id) as k", "cast(id as string) as t").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    asked = spark.range(0, 2000, 10).selectExpr("id as k")
    may, stay = shared.split(rows, asked, ["k"])
    first, second = ([tuple(r) for r in part.collect()] for part in (may, stay))
    assert sorted(first + second, key=str) == sorted(map(tuple, rows.collect()), key=str) and may.columns == rows.columns
    assert {k for k, _ in first} >= set(range(0, 2000, 10)) and len(first) < 220
    assert "hashpartitioning" not in stay._jdf.queryExecution().executedPlan().toString()
    nothing = shared.split(rows, asked.where("false"), ["k"])
    assert nothing[0].count() == 0 and nothing[1].count() == 2000


def test_few_texts_are_dealt_out(spark, monkeypatch):
    """Only texts that may be compared, dropped or repeated are shuffled; before, each comparison and the last step dealt out all of them."""
    dealt = []

    def counted(df, rows, keys):
        may, stay = shared.split(df, rows, keys)
        dealt.append(may.count())
        return may, stay

    monkeypatch.setattr(nc, "split", counted)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r["doc_id"] for r in nc.keep_one(docs).select("doc_id").collect()]
    between(ids, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(dealt) == 4 and max(dealt) < docs.count() / 2 and dealt[-1] >= docs.count() - len(ids)
