from tidemark.llm import toxicity


def test_no_toxic_word_is_dropped_from_a_large_vocabulary(spark):
    words = ["".join(chr(97 + (k // 26**p) % 26) for p in range(3)) + "qzxvwkjy" for k in range(60)]
    rows = [(i, f"{words[i % 60]} {words[(i * 7 + 1) % 60]}", 1) for i in range(900)] + [(1000 + i, "plain speech about weather", 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learned = set(toxicity.train(docs, labels).weights)
    assert all(any((w + " ").startswith(e) for e in learned) for w in words)
