import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", "  ", None, "İ İ ÀÅ", "it's'll <|endoftext|> <|ENDOFTEXT|>x<|startoftext|>", "a b c\x1cd", "x." * 9000, "日本語 ﬁ １２", "word " * 9000, "Á̧ ́x"]


def check(pieces, texts):
    library = Tokenizer.from_file(PATH)
    expected = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    done = dict.fromkeys(expected, 0)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        ids = expected[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["start"] == done[r["doc_id"]] and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        done[r["doc_id"]] += r["length"]
    assert done == {i: len(ids) for i, ids in expected.items()}
    sizes = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes.get(r["sequence_id"], 0)
        sizes[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sizes.values()) <= 4096
    padding = sum(0 if s & (s - 1) == 0 else 4096 - s for s in sizes.values())
    return padding / sum(sizes.values())


@pytest.mark.parametrize("block", [packing.BLOCK, 9000])
def test_pieces_cover_the_documents(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert check(packing.pack(rows.coalesce(1), PATH).collect(), texts) < 0.02
    assert packing.pack(rows.where("false"), PATH).count() == 0


def brute(total, documents, sentences):
    places = sorted({0, total, *documents, *sentences})
    cost = {0: 0.0}
    for p in places[1:]:
        options = [cost[q] + (0 if p - q in packing.EXEMPT else packing.LENGTH - (p - q)) for q in places if q < p <= q + packing.LENGTH]
        cost[p] = min(options) + packing.EACH + (0 if p in documents else packing.SENTENCE)
    return cost[total]


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        ends = np.cumsum([rng.randint(1, 250) for _ in range(150)])
        documents = np.array([e for e in ends if rng.random() < 0.3] + [ends[-1]])
        total = int(ends[-1])
        windows = [*packing.cuts(total, documents, ends, False), total]
        cost, a = 0.0, 0
        for b in windows:
            cost += packing.EACH + (0 if b in documents else packing.SENTENCE) + (0 if b - a in packing.EXEMPT else packing.LENGTH - (b - a))
            a = b
        assert cost == brute(total, set(documents.tolist()), set(ends.tolist()))


def test_sequence_ids_differ_between_partitions(spark):
    rows = spark.createDataFrame([(i, "some words here") for i in range(40)], "doc_id long, text string").repartition(4)
    texts = {i: "some words here" for i in range(40)}
    check(packing.pack(rows, PATH).collect(), texts)


def test_chunks_as_one_by_one():
    """Slices cut and encoded at once have the ids of whole texts; new words go to the library some at a time."""
    texts = ["", "  ", " . a", "A.B,c!d", "<|endoftext|>Ab.c <|x", ".x", "'s it's a's", "straße é́ éx ÿ", "a\x1cb\x0bc", "x1.2..3", "%", *(f"neu{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}o." for k in range(1000))]
    library = Tokenizer.from_file(PATH)
    own, asked = packing.Chunks(PATH), []

    class Counting:
        def encode_batch_fast(self, batch, **how):
            asked.append(len(batch))
            return library.encode_batch_fast(batch, **how)

    own.library = Counting()
    array = pa.array(["before", *texts], pa.large_string())[1:]
    for text, (ids, ends) in zip(texts, own.encode(array), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text
        assert all(0 <= e < len(ids) for e in ends.tolist())
    assert sum(asked) < 100
    assert [e.tolist() for _, e in own.encode(pa.array(["one two. three!", "no end"], pa.large_string()))] == [[3, 5], []]
