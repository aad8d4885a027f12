import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, license_scan, packing, quality_rules, simhash, spotsigs, tokencount, toxicity

ROWS = [(1, "Some words, 12 of them!"), (2, None), (3, ""), (3, "Some words, 12 of them!"), (None, "no id")]
OPERATORS = {
    "op2": simhash.near_duplicates,
    "op3": lambda d: bpe.digests(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    "op4": spotsigs.edited_likeness,
    "op6": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "op7": lambda d: tokencount.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op8": license_scan.scan,
    "op10": lambda d: toxicity.score(d, toxicity.Lexicon({"idiot": 3.0})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_named_like_results_change_nothing(spark, name):
    docs, operator = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1), OPERATORS[name]
    plain = operator(docs)
    clash = operator(docs.withColumns({c: F.lit("clash") for c in (*plain.columns, "row", "node", "key", "value", "part", "n") if c != "doc_id"}).coalesce(1))
    assert clash.columns == plain.columns
    assert sorted(map(str, clash.collect())) == sorted(map(str, plain.collect()))
    assert operator(docs.where("false")).count() == 0


def test_rows_without_language_and_source_form_a_group(spark):
    sound = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), 40 + F.col("id") % 60), lambda k: F.concat(F.lit("word"), (k * (F.col("id") + 7) % 1009).cast("string"))), " ").alias("text"))
    odd = spark.createDataFrame([(1000, " ".join(f"{'#$%&*' * 9}{k}" for k in range(60)))], "doc_id long, text string")
    rows = sound.unionByName(odd).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    kept = {r["doc_id"] for r in quality_rules.quality_rules(rows).where("kept").collect()}
    assert 1000 not in kept and len(kept) == 300


def test_a_text_of_several_slices(spark):
    """Over four megabytes in one row, between short ones."""
    long = "The cat sat on the mat. All rights reserved. " * 120_000
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, "of three words")], "doc_id long, text string")
    scanned = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert scanned[2]["n_base"] == 120_000 and scanned[2]["n_words"] == 9 * 120_000
    edited = {r["doc_id"]: r for r in spotsigs.edited_likeness(docs).collect()}
    assert edited[2]["n_chars"] == len(long) and 0 < edited[2]["near_edited"] <= 1
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect()}[2] == 9 * 120_000
    assert toxicity.score(docs, toxicity.Lexicon({"idiot": 3.0})).count() == 3
