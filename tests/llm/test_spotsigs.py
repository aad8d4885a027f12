import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spotsigs as ss

SF = "/root/testdata/sf0.001"


def plain_signatures(text, begins):
    """``begins``: the content words whose hash begins a chain."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [k for k, w in enumerate(words) if w not in ss.ANCHORS]
    out = set()
    for k, w in enumerate(words):
        own = w not in ss.ANCHORS
        if not own or w in begins or k == content[0]:
            chain = [words[c] for c in content if c > k or own and c == k][: ss.CHAIN]
            out.add(("^" if own else w, *chain, *[""] * (ss.CHAIN - len(chain))))
    return out


def beginning(spark, texts):
    words = sorted({w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower())})
    frame = spark.createDataFrame([(w,) for w in words] or [("",)], "w string")
    return {r["w"] for r in frame.where(f"pmod(xxhash64(w), {ss.SHARE}) = 0").collect()}


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(spark, rows):
    rows = sorted(rows)
    begins = beginning(spark, [t for k, (_, text) in enumerate(rows) for t in (text, text[: len(text) - len(text) // 4] + rows[(k + 1) % len(rows)][1][: len(text) // 4])])
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        s, e, n = (plain_signatures(t, begins) for t in (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(s, e), jaccard(s, n))
    return out


@pytest.mark.parametrize("extra", [[], [(-5, ""), (10**9, "!! ?"), (10**9 + 1, "The\n\n of the"), (10**9 + 2, "of"), (10**9 + 3, "\n\nx ^ y\n"), (10**9 + 4, "the cat sat " * 1_000), (10**9 + 5, "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn of")]])
def test_matches_brute_force(spark, extra):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    want = expected(spark, texts)
    got = ss.edited_likeness(rows.withColumns({c: F.lit("clash") for c in ("own", "range", "key", "edited", "firsts")})).collect()
    assert len(got) == len(want)
    by_text, of = {}, dict(texts)
    for r in got:
        n, sha, near, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(near, abs=1e-12) and r["near_next"] == pytest.approx(after, abs=1e-12)
        assert by_text.setdefault(of[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_small_tables(spark):
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:2] + tuple(r)[3:] for r in ss.edited_likeness(one).collect()] == [(1, 0, "", "", 1.0, 1.0)]
    assert ss.edited_likeness(one.where("false")).count() == 0
    rows = spark.createDataFrame([(2, "b " * 9), (None, "abcd"), (2, "c " * 9), (2, "b " * 9), (1, "the end of it")], "doc_id long, text string")
    got = ss.edited_likeness(rows).collect()
    assert sorted(r["n_chars"] for r in got) == [4, 13, 18, 18, 18]


def test_ids_of_any_type_and_one_hot_id(spark):
    rows = [("a", "of one two"), ("b", "of three"), (None, "four")]
    got = {r["doc_id"]: r["edited_sha256"] for r in ss.edited_likeness(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in (("a", "of one tof"), ("b", "of thrfo"), (None, "fouo"))}
    hot = spark.range(400).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    dealt = ss.with_successors(hot, ss.signatures)
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300
    assert sorted(r["text"] for r in dealt.collect()) == sorted(r["next_text"] for r in dealt.collect())


def test_similar_finds_every_pair_over_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = docs.where("doc_id % 5 = 0")
    begins = beginning(spark, [r["text"] for r in docs.collect()])
    sets = {r["text"]: frozenset(plain_signatures(r["text"], begins)) for r in docs.collect()}
    mine = {frozenset(plain_signatures(r["text"], begins)) for r in asked.collect()}
    want = sum(jaccard(a, b) >= 0.6 for a in mine for b in set(sets.values()) if a and b)
    assert ss.similar(asked, docs, 0.6).count() == want


def test_an_edit_of_the_last_quarter_leaves_the_rest(spark):
    """No long text has likeness 0 to its edited text, and most signatures of the first three quarters stay."""
    rows = ss.edited_likeness(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) >= 50")).collect()
    assert len(rows) > 900 and min(r["near_edited"] for r in rows) > 0
    assert sorted(r["near_edited"] for r in rows)[len(rows) // 20] > 0.3
