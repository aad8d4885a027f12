import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def plain(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n, total = len(held), sum(m for *_, m in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in held:
            m = 25 + (75 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i if i is not None else 1 << 62))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def result(docs, items):
    return sorted((r["item_id"], r["rank"], r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["score"]) for r in lexical.search(docs, items).collect())


def test_terms():
    for text in ["", None, "Ab1-ÄÖ_é’s x", "日本語 Straße\x7fa`b@C[D{e/f:g 9"]:
        assert [t.decode() for t in lexical.terms_of(text)] == TERM.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("block,limit", [(4096, 16 << 20), (7, 200)])
def test_random_texts(spark, monkeypatch, block, limit):
    """One block and many, items in one group and in several."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(4)
    words = [*"abcdefghij", "Äpfel", "äpfel", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 40))) for k in range(120)] + [(3, text(9)), (None, "a b c"), (200, None), (201, "  ;; "), *[(300 + k, "b a same") for k in range(15)]]
    items = [(k, text(rng.randint(1, 12))) for k in range(12)] + [(50, None), (51, "absent words only"), (52, "same same a"), (52, "same")]
    groups = lexical.groups_of
    monkeypatch.setattr(lexical, "groups_of", lambda df: groups(df, limit))
    assert result(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM)) == plain(docs, items)


def test_terms_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(lexical.at, "token_hash", lambda w: 7)
    monkeypatch.setattr(lexical.at.RollingHash, "ranges", lambda self, s, e: (0 * s + 7).astype("uint64"))
    looked_for = lexical.Terms([b"ab", b"cd", b"e"])
    import pyarrow as pa

    n, rows, ids = looked_for.find(pa.array(["ab xx cd e", "cd"], pa.large_string()))
    assert n.tolist() == [4, 1] and sorted(zip(rows.tolist(), ids.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 1)]


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    got = result(docs, items)
    assert got == plain(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))
    clash = docs.select("doc_id", "text").withColumns({c: F.lit("clash") for c in ("n", "ids", "counts", "item", "score", "rank", "group")})
    assert result(clash, items.withColumn("item", F.lit("clash"))) == got
    assert result(docs.where("false"), items) == result(docs, items.where("false")) == []


def test_a_long_text_and_one_term(spark):
    docs = [(1, "word " * 2_000_000), (2, "word other"), (3, "no such")]
    items = [(1, "word"), (2, "other word word")]
    assert result(spark.createDataFrame(docs, DOC).coalesce(1), spark.createDataFrame(items, ITEM)) == plain(docs, items)
