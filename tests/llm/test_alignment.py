import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.tokencount import byte_characters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", "abc ", " abc", "a  b", "x\n y", "x\n  y \n z\t ", "é 日本 😀!", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "  x", "it's  'll", "\x00a", "a　 b", "don't  stop", "cóte ﬁ ½"]


@pytest.fixture(scope="module")
def plain():
    """A plain version for whole texts: the library's ids of whole texts, all pairs of tokens looked at."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_byte = byte_characters()
    a_bytes = lambda i: bytes(of_byte[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, of):
        out, k = [], 0
        for i in ids:
            out.append((k, k := k + len(of(i)), i))
        return out

    def one(text):
        text = text or ""
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(map(a_bytes, ia)) != whole or b"".join(map(b_bytes, ib)) != whole:
            return (0, 0, 0, ""), []
        sa, sb = spans(ia, a_bytes), spans(ib, b_bytes)
        links = [(x, y) for s, e, x in sa for p, q, y in sb if max(s, p) < min(e, q)]
        ends = sorted({e for _, e, _ in sa} & {q for _, q, _ in sb})
        groups = [f"{','.join(str(x) for s, e, x in sa if lo < e <= hi)}|{','.join(str(y) for p, q, y in sb if lo < q <= hi)}" for lo, hi in zip([0, *ends], ends, strict=False)]
        return (len(ia), len(ib), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()), links

    def many(texts):
        found = [one(t) for t in texts]
        count = Counter(link for _, links in found for link in links)
        highest = Counter()
        for (_, y), n in count.items():
            highest[y] = max(highest[y], n)
        return [(na, nb, ng, len(links), sum(count[k] == highest[k[1]] for k in links), sum(count[k] for k in links), sha) for (na, nb, ng, sha), links in found]

    return many


def result(docs, **options):
    return sorted((tuple(r) for r in alignment.align(docs, A, B, **options).collect()), key=str)


@pytest.mark.parametrize("heavy", [1 << 18, 40, 1])
def test_small_texts_against_all_pairs(spark, plain, heavy):
    """With every pair in the tasks, with some, with none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 700").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(10**6 + k, t) for k, t in enumerate([None, *ODD, *ODD[:9]])]
    expected = sorted(((i, *f) for (i, _), f in zip(rows, plain([t for _, t in rows]), strict=True)), key=str)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heavy=heavy) == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab. '\n\t!é日 　<>0x")), max_size=25), min_size=1, max_size=5))
def test_parts_have_the_ids_of_whole_texts(texts):
    own = alignment.pair(A, B)
    a, a_per, b, b_per = own.ids(texts)
    assert own.by_parts
    assert [x.tolist() for x in np.split(a, np.cumsum(a_per)[:-1])] == [own.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    for t, got in zip(texts, np.split(b, np.cumsum(b_per)[:-1]), strict=True):
        if t:
            assert got.tolist() == own.b.encode(t)


def test_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    own = alignment.Pair(A, B)
    one = lambda t: alignment.Aligned(own, pa.array([t], pa.large_string()))
    first = one("some words of a text").hashes()
    for k in range(5):
        one(f"other {k} words {k * k}")
    assert one("some words of a text").hashes() == first


def test_rows_columns_and_empty_tables(spark):
    rows = [(1, "two words"), (1, "two words"), (None, "no id"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain_ = result(docs)
    assert len(plain_) == 4 and plain_[0][1:] == plain_[1][1:]
    clash = docs.withColumns({c: F.lit("clash") for c in ("row", "pair", "links", "n_a", "count", "best", "groups_sha256")}).coalesce(1)
    assert result(clash) == plain_
    assert result(docs.where("false")) == []


def test_a_text_of_several_slices(spark):
    long = "The cat sat on the mat. " * 200_000
    rows = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame([(1, "short"), (2, long), (3, "of three words")], "doc_id long, text string").coalesce(1), A, B).collect()}
    whole = alignment.pair(A, B)
    assert rows[2]["n_a"] == len(whole.a.encode(" " + long, add_special_tokens=False).ids) and rows[2]["n_b"] == len(whole.b.encode(long))
    assert rows[2]["n_links"] == rows[2]["n_a"] + rows[2]["n_b"] - rows[2]["n_groups"]
    assert rows[2]["count_sum"] > rows[2]["n_links"] * 100_000
