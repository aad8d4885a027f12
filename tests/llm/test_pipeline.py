import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from test_nearcopies import between
from test_packing import check

from tidemark.llm import quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in kept.collect()}
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert out.columns == columns
            assert all(before[r["doc_id"]] == r for r in out.collect())
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if k == 0:
            assert ids == {r["doc_id"] for r in quality_rules.quality_rules(kept).where("kept").collect()}
        elif k == 1:
            model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == {r["doc_id"] for r in quality_classifier.score(kept, model).where("predicted = 1").collect()}
        elif k == 2:
            between([r["doc_id"] for r in out.collect()], [(i, r["text"]) for i, r in before.items()])
        else:
            check(out.collect(), {i: r["text"] for i, r in before.items()})
        kept = out
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_odd_rows_run_through_all_stages(spark, tmp_path):
    """Null and very long texts, null ids, repeated rows and extra columns with the operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(r["text"] for r in docs.orderBy("doc_id").limit(100).collect() if r["text"])
    first = docs.orderBy("doc_id").first().asDict()
    odd = spark.createDataFrame([{**first, "doc_id": 10**9 + k, "text": t} for k, t in enumerate([None, "", " ", "a", long, long + " tail"])] + [{**first, "doc_id": None}, first], docs.schema)
    names = ["node", "root", "key", "start", "kept", "score", "far", "n_words", "row", "b"]
    docs.unionByName(odd).withColumns({n: F.lit("clash") for n in names}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        columns = kept.columns
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == columns and kept.where("root <> 'clash'").count() == 0
    texts = {r["doc_id"]: r["text"] for r in kept.where("doc_id is not null").collect()}
    assert not {10**9, 10**9 + 1, 10**9 + 2, 10**9 + 3, 10**9 + 5} & set(texts) and len(texts) == kept.where("doc_id is not null").count()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect()
    check(pieces, texts)


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(names)


def test_empty_documents(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").where("false" if table == "documents" else "true").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_quality_classifier", "op10_toxicity"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
