import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan as ls

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "CC BY", "cc-by", "cc  by cc\nby", "CC0", "ccby", "café by cc by", "All rights, reserved. ALL RIGHTS RESERVED", "General public license " * 3, "Copyright (c) 2020-2024 Foo Bar. All rights reserved.", "Licensed under the Apache License, Version 2.0.", "x Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = ls.scan(rows).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:6] == plain(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    labels = {texts[r["doc_id"]]: r["labels"] for r in got}
    assert labels[ODD[-5]] == "copyright,reserved" and labels[ODD[-4]] == "apache-2.0"
    assert labels[ODD[-3]] == "cc-by,cc-by-nc" and labels[ODD[-2]] == "mit" and labels[ODD[-1]] == "gpl"
    assert ls.scan(rows.where("false")).count() == 0


def as_pattern(template):
    """The template as a regular expression over words that are each followed by a space."""
    out = []
    for token in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template):
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        elif token.startswith("<<"):
            out.append(r"(?:\S+ ){0,%s}" % token[2:-2])
        else:
            out += [re.escape(w) + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", token.lower())]
    return re.compile("".join(out))


PATTERNS = [(as_pattern(t), label) for label, ts in ls.TEMPLATES.items() for t in ts]


def plain_labels(text):
    """(labels, score) by trying each end of a match at each word."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    labels, covered = set(), 0
    for i in range(len(words)):
        longest = 0
        for phrase, label in ls.PHRASES.items():
            if words[i : i + len(phrase.split())] == phrase.split():
                labels.add(label)
                longest = max(longest, len(phrase.split()))
        rest = "".join(w + " " for w in words[i:])
        for pattern, label in PATTERNS:
            if pattern.match(rest):
                ends = [k for k in range(1, len(words) - i + 1) if pattern.fullmatch("".join(w + " " for w in words[i : i + k]))]
                if ends:
                    labels.add(label)
                    longest = max(longest, ends[-1])
        covered += longest
    return ",".join(sorted(labels)), 1 - 0.5 ** (covered / 2)


def filled(template, rng):
    """A text that the template accepts: optional parts in or out, random words in replaceable places."""
    if not re.search(r"\[\[|<<", template):
        return template
    inner = re.search(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", template, re.S)
    if inner:
        return filled(template[: inner.start()] + (inner[1] if rng.random() < 0.5 else " ") + template[inner.end() :], rng)
    return filled(re.sub(r"<<(\d+)>>", lambda m: " ".join(f"Name{rng.randrange(9)}" for _ in range(rng.randrange(int(m[1]) + 1))), template), rng)


def written(words, rng):
    return "".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", " ", "\n", ", ", " - "]) for w in words)


def test_labels_and_score_match_brute_force(spark):
    rng = random.Random(4)
    texts = list(ODD)
    for label, templates in ls.TEMPLATES.items():
        for template in templates:
            words = filled(template, rng).split()
            texts.append("before it " + written(words, rng) + " after it")
            texts.append(written([w for k, w in enumerate(words) if k != len(words) * 2 // 3], rng))  # a word is missing
            texts.append(written([*words[: len(words) // 2], "not", *words[len(words) // 2 :]], rng))  # a word too many
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("labels", "score", "n_words")})
    got = {r["doc_id"]: r for r in ls.scan(rows).collect()}
    for i, text in enumerate(texts):
        labels, score = plain_labels(text)
        assert (got[i]["labels"], got[i]["score"]) == (labels, pytest.approx(score)), text
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '(?i)licen[sc]e|copyright|rights|cc by' or doc_id % 20 = 0")
    of = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in ls.scan(docs).collect():
        assert (r["labels"], r["score"]) == (plain_labels(of[r["doc_id"]])[0], pytest.approx(plain_labels(of[r["doc_id"]])[1]))


MIT = """The MIT License (MIT)

Copyright (c) 2019-2021 Jane Roe <jane@example.org>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.
"""


def test_a_whole_licence_and_its_altered_forms(spark):
    altered = MIT.replace("subject to the following conditions", "subject to no conditions"), MIT.replace("Jane Roe", "Some Other Holder Ltd")
    rows = spark.createDataFrame(list(enumerate([MIT, *altered, "word " * 400_000 + MIT])), "doc_id long, text string")
    assert [r["labels"] for r in ls.scan(rows).orderBy("doc_id").collect()] == ["mit", "", "mit", "mit"]


def words(text):
    tokens = text.encode().split()
    return tokens.__getitem__, 0, len(tokens)


@pytest.mark.parametrize(
    ("template", "text", "size"),
    [("a [[b c]] d", "a d", 2), ("a [[b c]] d", "a b c d", 4), ("a [[b c]] d", "a b d", 0), ("a <<2>> d", "a d", 2), ("a <<2>> d", "a x y d", 4), ("a <<2>> d", "a x y z d", 0), ("a [[b [[c]]]] d", "a b d", 3), ("a [[<<1>>]] b <<2>>", "a b x y z", 4), ("[[a]] b", "b", 1), ("[[a]] b", "a b", 2), ("a b", "a", 0)],
)
def test_templates(template, text, size):
    assert ls.Automaton(template).match(*words(text)) == size


def test_a_template_needs_wording_first():
    for template in ("<<2>> a", "[[a]]"):
        with pytest.raises(ValueError):
            ls.Automaton(template)
