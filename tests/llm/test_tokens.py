import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, pretokens, tokencount

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", "  ", " \n", "a  b", "it's 'size' ''s \n's we'll they've I'm 'r 're'd 'v'l ll 'lL", "x\t 1 2３ ½ Ⅷ", "né ñ ß́ 日本語 😀😀   x", "!!'s-- 'tis", "a" * 300, "end  ", "\r\n\r\nx", "<|endoftext|>a <|endoftext|> b", "'", "'r", "'re", "' s"]
CHARS = st.text(st.sampled_from(list("'sretvlmd 1\n\t!aé。  日")), max_size=30)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(texts):
    out = [[] for _ in texts]
    for first, local, raw, starts, row in pretokens.pieces_of(pa.array(texts, pa.large_string())):
        for a, b, r in zip(starts, [*starts[1:], len(raw)], row, strict=True):
            out[first + r].append(raw[a:b].decode())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(CHARS, max_size=6))
def test_boundaries_follow_the_pattern(texts):
    assert cut(texts) == [regex.findall(P.PATTERN, t) for t in texts]


def test_boundaries_across_blocks_and_parts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("'sretvlmd 1\n!aé") for _ in range(n)) for n in (5000, 3, 2000)]
    assert cut(texts) == [regex.findall(P.PATTERN, t) for t in texts]
    monkeypatch.setattr(pretokens.at, "SLICE_BYTES", 100)
    assert cut(texts) == [regex.findall(P.PATTERN, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(CHARS, st.text(max_size=20)), min_size=1, max_size=4))
def test_encode_and_decode(tik, texts):
    own = bpe.encoder(RANKS)
    for first, ids, offsets, rows in own.encode(pa.array(texts, pa.large_string())):
        for r in range(len(rows) - 1):
            part = ids[rows[r] : rows[r + 1]]
            assert part.tolist() == tik.encode_ordinary(texts[first + r])
            assert own.decode(part) == texts[first + r].encode()


def test_query_matches_the_library(spark, tik):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, *ODD])], "doc_id long, text string")
    rows = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = bpe.digests(rows, RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    library = Tokenizer.from_file(JSON)
    for r in tokencount.token_counts(rows, JSON).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert bpe.digests(rows.where("false"), RANKS).count() == tokencount.token_counts(rows.where("false"), JSON).count() == 0


def test_long_pieces():
    own, count = bpe.encoder(RANKS), tokencount.counter(JSON)
    rng = random.Random(5)
    for n in (47, 60, 400):
        word = "".join(rng.choice("abcdeft") for _ in range(n)).encode()
        parts = bpe.merge_long([word[i : i + 1] for i in range(n)], lambda a, b: own.ranks.get(a + b), lambda a, b: a + b)
        assert b"".join(parts) == word
        assert [own.ranks[p] for p in parts] == own.merged(word)
    word = "xyz" * 50_000
    assert count.count(word.encode()) == len(Tokenizer.from_file(JSON).encode(word).ids)
