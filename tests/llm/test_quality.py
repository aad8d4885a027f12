import collections
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import arrowtext, components, quality_classifier, quality_rules, toxicity

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
SF3 = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "one two three four five six seven eight " * 3, "x\nx\n\nx\n y\ny", "#*$%&|<> # é日本", "a b c d e f g h a b c d e f g h a", "w " * 300, "\n".join(f"line {i % 3}" for i in range(30))]


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def quantile(values, share):
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def plain_distances(x, half):
    """Scaled squared distances of one group's vectors, by steps from the three starts; ``half`` marks the rows of the third."""
    floors = np.array(quality_rules.FLOORS)
    centre = np.array([quantile(c, 0.5) for c in x.T])
    scale = np.maximum([1.4826 * quantile(abs(c - m), 0.5) for c, m in zip(x.T, centre, strict=True)], floors)
    def step(mean, inverse):
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        return of(x[d <= quantile(d, quality_rules.SUBSET)])

    def of(rows):
        cov = np.cov(rows.T, bias=True).reshape(5, 5) + np.diag(floors**2)
        return rows.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    worst = np.max(abs(x - centre) / scale, axis=1)
    found = [step(*s[:2]) for s in [(centre, np.diag(1 / scale**2)), of(x[worst <= quantile(worst, 0.5)]), *([of(x[half])] if half.any() else [])]]
    for _ in range(quality_rules.TRIAL - 1):
        found = [step(*s[:2]) for s in found]
    best = min(found, key=lambda s: s[2])
    for _ in range(quality_rules.MOST_STEPS - quality_rules.TRIAL):
        after = step(*best[:2])
        falls, best = best[2] - after[2], min(after, best, key=lambda s: s[2])
        if falls <= quality_rules.SETTLED:
            break
    mean, inverse, _ = best
    d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    return d / max(1.0, quantile(d, 0.5) / quality_rules.MEDIAN)


def test_rules_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text", "lang", "source")
    rows = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None if i % 2 else "xx", "s") for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string"))
    texts = {r["doc_id"]: r for r in rows.collect()}
    counts = {i: plain_counts(r["text"]) for i, r in texts.items()}
    terms = quality_rules.with_terms(quality_rules.with_counts(rows))
    halves = {r["doc_id"]: r["h"] == 0 for r in terms.select("doc_id", F.pmod(F.xxhash64(*quality_rules.TERMS), F.lit(2)).alias("h")).collect()}
    sources = collections.Counter((r["lang"], r["source"]) for r in texts.values())
    langs = collections.Counter(r["lang"] for r in texts.values() if sources[r["lang"], r["source"]] < quality_rules.LEAST)
    groups = collections.defaultdict(list)
    for i, r in texts.items():
        own = (r["lang"], r["source"])
        groups[own if sources[own] >= quality_rules.LEAST else (r["lang"],) if langs[r["lang"]] >= quality_rules.LEAST else ()].append(i)
    rejected, borderline = set(), set()
    for key, ids in groups.items():
        every = ids if key else list(texts)  # the rest is judged by all rows
        v = np.array([(math.log1p(n), c / max(1, n), math.sqrt(s / max(1, c)), math.sqrt(d / max(1, k)), math.sqrt(w / max(1, n))) for n, c, s, d, w, k in (counts[i] for i in every)])
        d = dict(zip(every, plain_distances(v, np.array([halves[i] for i in every])), strict=True))
        rejected |= {i for i in ids if d[i] > quality_rules.CUTOFF}
        borderline |= {i for i in ids if abs(d[i] - quality_rules.CUTOFF) < 0.05 * quality_rules.CUTOFF}
    assert () in groups and len(borderline) < 20
    got = quality_rules.quality_rules(rows).collect()
    assert len(got) == len(texts) and len(rejected) > 20
    for r in got:
        n, chars, symbols, lines, repeated, _ = counts[r["doc_id"]]
        failed = n < 20 or 100 * repeated > 30 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeated, failed)
        assert r["doc_id"] in borderline or r["kept"] == (not failed and r["doc_id"] not in rejected)
    kept = {r["doc_id"] for r in quality_rules.keep_good(rows.withColumn("n_words", F.lit("clash"))).collect()}
    assert kept == {r["doc_id"] for r in got if r["kept"]}
    assert quality_rules.quality_rules(rows.where("false")).count() == 0


def test_a_group_is_estimated_alone_as_among_others(spark, monkeypatch):
    """Groups that settle at different steps; with fewer steps allowed some don't settle, and say so."""
    rng = np.random.default_rng(11)
    group = {"still": rng.normal(0, 0.01, (200, 5)), "mixed": np.concatenate([rng.normal(0, 1, (300, 5)), rng.normal(3, 2, (250, 5))]), "wide": rng.standard_t(2, (600, 5)) * 3}
    rows = spark.createDataFrame([(k, *map(float, x)) for k, xs in group.items() for x in xs], "key string, x0 double, x1 double, x2 double, x3 double, x4 double").coalesce(1).cache()
    steps, stepped = [], quality_rules._stepped
    monkeypatch.setattr(quality_rules, "_stepped", lambda k, t, n: (steps.append(t.select("key").distinct().count()), stepped(k, t, n))[1])
    among = {r["key"]: r for r in quality_rules.concentrated(rows, 3).collect()}
    assert set(among) == set(group) and steps[quality_rules.TRIAL] == 3 and 0 < steps[-1] < 3
    for key in ("still", "wide"):
        (alone,) = quality_rules.concentrated(rows.where(F.col("key") == key), 1).collect()
        assert alone["settled"] and all(among[key][c] == v if isinstance(v, str) else among[key][c] == pytest.approx(v, abs=1e-9) for c, v in alone.asDict().items())
    monkeypatch.setattr(quality_rules, "MOST_STEPS", quality_rules.TRIAL + 1)
    assert {r["settled"] for r in quality_rules.concentrated(rows, 3).collect()} == {True, False}


def plain_vector(text):
    kind = lambda b: 0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalpha() else 2 if 48 <= b < 58 else 3
    tokens, data = [], (text or "").encode()
    for k, b in enumerate(data):
        if tokens and k and kind(b) == kind(data[k - 1]):
            tokens[-1] += bytes([b])
        else:
            tokens.append(bytes([b]))
    tokens = [t for t in tokens if kind(t[0])]
    h = [np.uint64(arrowtext.token_hash(t.decode())) for t in tokens]
    mixed = lambda x: arrowtext.mix(np.array([x], np.uint64))[0]
    counts = collections.Counter(int(x >> np.uint64(46)) for x in h)
    with np.errstate(over="ignore"):
        counts.update(int(mixed(a * quality_classifier._SALT[0] + b) >> np.uint64(46)) for a, b in zip(h, h[1:], strict=False))
    counts.update(1 for a, b in zip(tokens, tokens[1:], strict=False) if a == b)
    threes = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
    counts.update({2: len(threes) - len(set(threes))} if len(threes) > len(set(threes)) else {})
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    return {k: quality_classifier.LENGTH * math.log1p(c) / length for k, c in counts.items()}


@pytest.mark.filterwarnings("ignore")
def test_features_match_plain_counts():
    texts = [t or "" for t in ODD] + ["The the, THE!! the### 12 a1b2  ñandú ñ—x", "b b b", "."]
    offsets, index, value = quality_classifier.features(pa.array(texts, pa.large_string()))
    for r, text in enumerate(texts):
        got = dict(zip(index[offsets[r] : offsets[r + 1]].tolist(), value[offsets[r] : offsets[r + 1]].tolist(), strict=True))
        assert got == pytest.approx(plain_vector(text))


@pytest.mark.parametrize("size", [7, 50, 333, 5000])
def test_long_texts_in_pieces_equal_the_whole(size):
    rng = np.random.default_rng(size)
    text = "".join(rng.choice(["word", "Word!", " ", "\n", " 12", "é, ", "the end of it ", "--"], 2000))
    whole = quality_classifier.features(pa.array([text], pa.large_string()))
    parts = quality_classifier.features(pa.array([text], pa.large_string()), size)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def plain_ftrl(vectors, labels, orders):
    """Weights after FTRL-proximal passes in the given orders, a coordinate at a time."""
    q = quality_classifier
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)
    for order in orders:
        for k in order:
            v = {**vectors[k], q.DIM: 1.0}
            w = {i: weight(i) for i in v}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in v.items())))
            for i, x in v.items():
                g = (p - labels[k]) * x
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training_and_scores_match_plain_ftrl(spark, monkeypatch):
    """The whole query on one shard: vectors, FTRL passes and scores."""
    monkeypatch.setattr(quality_classifier, "SHARDS", 1)
    texts = {i: f"good words here number {i % 7} again" if i % 2 else f"bad! bad! stuff {i % 5} 99" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    ids = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    order = sorted(ids, key=lambda i: (i * 0x9E3779B1 & 0xFFFFFFFF, i))
    orders = [[order[k] for k in np.random.default_rng(e).permutation(len(order))] for e in range(quality_classifier.EPOCHS)]
    vectors = {i: plain_vector(t) for i, t in texts.items()}
    weights = plain_ftrl(vectors, {i: i % 2 for i in ids}, orders)
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(spark, docs, labels).collect()}
    for i, v in vectors.items():
        score = 1 / (1 + math.exp(-sum(weights.get(b, 0.0) * x for b, x in v.items()) - weights[quality_classifier.DIM]))
        assert got[i]["score"] == pytest.approx(score, abs=1e-4) and got[i]["predicted"] == (got[i]["score"] >= 0.3) and got[i]["held_out"] == (i not in ids)


def quality_of(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    ones, zeros = [r["score"] for r in rows if r[label] == 1], [r["score"] for r in rows if r[label] == 0]
    auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    return auc, sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(docs.withColumn("score", F.lit("clash")), model)
    auc, accuracy = quality_of(scored, labels, "quality")
    assert auc > 0.95 and accuracy > 0.9 and scored.count() == docs.count()
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, ODD[4]])] + [(None, "x")], "doc_id long, text string")
    got = quality_classifier.score(odd, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, len(ODD))}) == 1
    again = quality_classifier.train(docs.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights, again.weights, atol=1e-5)
    untrained = quality_classifier.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_classifier.score(odd, untrained).collect()} == {0.5}


def plain_features(lexicon, text):
    folded = toxicity.fold(text)
    hits, spared = {}, set()
    for phrase in lexicon.exceptions:
        for k in range(len(folded)):
            if folded.startswith(f" {phrase} ", k):
                spared |= set(range(k, k + len(phrase) + 1))
    for entry, weight in lexicon.weights.items():
        for k in range(len(folded)):
            if folded.startswith(" " + entry, k) and weight > hits.get(k, ("", 0))[1]:
                hits[k] = entry, weight
    kept = [h for k, h in hits.items() if k not in spared]
    total = sum(w for _, w in kept)
    return [1, math.log1p(100 * total / max(20, len(folded.split()))), math.log1p(total), math.log1p(len({e for e, _ in kept}))]


def test_folding_and_matching(spark):
    for text in ("You 1d10t!", "ІDIOT", "iԁiot", "Ｉｄｉｏｔ", "idi0ts", "$tupid", "5tup1d"):
        assert any(w.startswith(("idiot", "stupid")) for w in toxicity.fold(text).split()), text
    assert toxicity.fold("in 2024, 100 %") == " in " and toxicity.fold("") == " "
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.BASE, 3.0) | {"tras": 1.0})
    automaton = lexicon.automaton()
    texts = ["", "a trash can", "trash", "trashcan idiot idiotic trash", "class clown fish clown", "vidiot", "MORON " * 30, "sore loser loser"]
    got = lexicon.features(texts, automaton)
    assert np.allclose(got, [plain_features(lexicon, t) for t in texts])
    assert got[1].tolist() == [1, 0, 0, 0] and got[5].tolist() == [1, 0, 0, 0]
    assert lexicon.features(["trash can idiot"], automaton)[0, 3] == math.log1p(1)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert len(toxicity.score(odd, lexicon).collect()) == len(ODD)
    assert toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int")).weights == dict.fromkeys(toxicity.BASE, 3.0)


@pytest.mark.parametrize("size", [1, 20, 77])
def test_long_texts_fold_and_match_in_pieces_as_whole(monkeypatch, size):
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.BASE, 3.0) | {"tras": 1.0})
    rng = np.random.default_rng(size)
    text = " ".join(rng.choice(["trash", "can", "clown", "fish", "class", "sore", "loser", "1d10t", "word", "sco\u0441m", "42", "moron!"], 800))
    whole = lexicon.features([text], lexicon.automaton())
    monkeypatch.setattr(toxicity, "PIECE", size)
    assert np.allclose(whole, lexicon.features([text], lexicon.automaton())) and np.allclose(whole, [plain_features(lexicon, text)])


def test_many_hits_and_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.BASE, 3.0))
    automaton, took = lexicon.automaton(), []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        lexicon.features(["idiot trash can " * n], automaton)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_lexicon_and_fit_match_plain_counts(spark):
    """The whole query: entries, weights, coefficients and scores."""
    rng = np.random.default_rng(5)
    texts = {i: " ".join(rng.choice(["zorgon", "zorgot", "plain", "weather", "idiot", "talk"] if i % 3 == 0 else ["plain", "weather", "talk", "walk"], 30)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    ids = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    toxic, counts = sum(i % 3 == 0 for i in ids), collections.defaultdict(lambda: [0, 0])
    for i in ids:
        for e in {(w + " ")[:n] for w in texts[i].split() for n in range(4, min(10, len(w) + 1) + 1)}:
            counts[e][i % 3 == 0] += 1
    clean = len(ids) - toxic
    passed = {e: (n1, n0) for e, (n0, n1) in counts.items() if n1 >= max(3, 0.02 * toxic) and (n1 + 0.5) / toxic >= 10 * (n0 + 0.5) / clean}
    kept = {e for e, c in passed.items() if not any(f != e and f.startswith(e) and passed[f] == c for f in passed)}
    weights = dict.fromkeys(toxicity.BASE, 3.0) | {e: math.log((n1 + 0.5) / (toxic - n1 + 0.5) / ((n0 + 0.5) / (clean - n0 + 0.5))) for e, (n1, n0) in passed.items() if e in kept}
    lexicon = toxicity.train(docs, labels)
    assert lexicon.weights == pytest.approx(weights)
    x, y = np.array([plain_features(lexicon, texts[i]) for i in ids]), np.array([i % 3 == 0 for i in ids], float)
    p = 1 / (1 + np.exp(-x @ lexicon.coefficients))
    assert np.abs(x.T @ (y - p) - 0.05 * (lexicon.coefficients - toxicity.DEFAULT)).max() < 1e-3  # the gradient at the optimum
    for r in toxicity.score(docs, lexicon).collect():
        score = 1 / (1 + math.exp(-np.dot(plain_features(lexicon, texts[r["doc_id"]]), lexicon.coefficients)))
        assert r["score"] == pytest.approx(score) and r["predicted"] == (r["score"] >= 0.5)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF3}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, labels)
    auc, accuracy = quality_of(toxicity.score(docs, lexicon), labels, "toxic")
    assert auc > 0.9 and accuracy > 0.95
    automaton = lexicon.automaton()
    some = [r["text"] for r in docs.where("doc_id % 997 = 0").collect()]
    assert np.allclose(lexicon.features(some, automaton), [plain_features(lexicon, t) for t in some])


def test_small_tables_have_few_parts(spark):
    """A table of a row a group isn't stored, and read in every step, in as many parts as a shuffle has."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rows = quality_rules.with_terms(quality_rules.with_counts(spark.read.parquet(f"{SF}/documents.parquet"))).select("k_source", "k_lang", *quality_rules.TERMS).localCheckpoint()
        rules = quality_rules.estimate(rows)
        assert max(t.rdd.getNumPartitions() for t in (rules.table, rules.keys)) <= max(1, rules.sources // quality_rules.TASK_GROUPS) < 40
        edges = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 10], "a long, b long")
        found = components.components(edges)
        assert found.select("node").rdd.getNumPartitions() <= 1 + 40
        assert {(r["node"], r["root"]) for r in found.collect()} == {(k + 1, k // 10 * 10 + 1) for k in range(30)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_steps_ask_little_of_the_driver(spark, monkeypatch):
    """A step of the rules broadcasts one table in each of its two passes over the rows."""
    plans, to = [], quality_rules.cut
    monkeypatch.setattr(quality_rules, "cut", lambda df, *tasks: (plans.append(df._jdf.queryExecution().executedPlan().toString()), to(df, *tasks))[1])
    rows = quality_rules.with_terms(quality_rules.with_counts(spark.read.parquet(f"{SF}/documents.parquet"))).select("k_source", "k_lang", *quality_rules.TERMS).localCheckpoint()
    quality_rules.estimate(rows)
    reaches = [p for p in plans if "percentile_approx(far" in p]
    assert len(reaches) > quality_rules.TRIAL and max(p.count("BroadcastHashJoin") for p in reaches) == 1
