"""Quality rules: robust multivariate outliers per language and source, on DataFrame functions only.

Every text gets counts (words, characters in words, symbols, repeated lines, repeated 8-word windows). From them
a vector of ``TERMS`` transformed statistics is made, and for every language and source the minimum covariance
determinant is estimated: concentration steps (take the ``SUBSET`` share of the rows with the least Mahalanobis distance, estimate
mean and covariance anew from them) begin from each of ``STARTS``; after ``TRIAL`` steps the start with the least determinant is kept
for each group, and its steps go on until its determinant falls by no more than a ``SETTLED`` share. A settled group is stepped no further, so
other groups' rows never move its estimate; one that hasn't settled after ``MOST_STEPS`` is marked in ``Rules.table``. A row is rejected if its
squared distance, scaled so that the median row lies where a normal vector's would, exceeds ``CUTOFF``, or if it fails the base rules.
``FLOORS`` are standard deviations added to the covariance, so that a statistic that is zero in all sound texts doesn't reject a text
for a single symbol; with them every group has an estimate, down to a single row.

Starts: medians with median deviations; the rows nearest to the medians in every single term, at least half of them (their
mean and covariance); and a half of the rows chosen by a hash of their statistics. Sources with fewer than ``LEAST`` rows in a
language are pooled within the language, and pools with fewer than ``LEAST`` rows are judged by an estimate of all rows of the table.
Quantiles come from sketches of ``ACCURACY``, so a subset's share is exact for groups of up to that many rows and within
1 / ``ACCURACY`` beyond. All sums and quantiles combine before the shuffle, so one source may hold any share of the rows.

Edge cases: a null or empty text has no words and fails the base rules; null lang and source count as ''; repeated
rows are judged alike; extra columns are ignored (``keep_good`` carries them through); an empty table gives no
rows. Windows are compared by 64-bit hashes of their words, without a look at the words again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, stored

WINDOW = 8
SUBSET = 0.6
STARTS = ("medians", "near", "half")
#: Steps before starts are compared; the share of the determinant below which a fall counts as none; a group's steps at most.
TRIAL, SETTLED, MOST_STEPS = 2, 1e-3, 12
LEAST = 50
ACCURACY = 10_000
#: Log words, letters a word, symbols a letter, repeated lines a line, repeated words a word (the last three as square roots).
TERMS = ("x0", "x1", "x2", "x3", "x4")
FLOORS = (0.7, 0.35, 0.04, 0.16, 0.16)
#: Squared distance that one normal vector of five terms in a million exceeds, and the median one.
CUTOFF, MEDIAN = 37.0, 4.351
#: Up to so many groups their parameters (under 400 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: Groups that a task holds on average in the tables that have a row a group; rows in the table of terms.
TASK_GROUPS, TASK_ROWS = 10, 10_000

#: Key of the estimate of all rows.
ALL = "*"
_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more; window i covers words i to i + 7."""

    def again(s: Column) -> Column:
        last = F.size(s) - 1
        return F.transform(s, lambda e, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == e["h"])), e["i"]))

    def total(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(ordered, lambda s: total(F.sort_array(F.array_compact(again(s)))))


def with_counts(df: DataFrame) -> DataFrame:
    """``df`` (with a column text) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spoken = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    cut_up = df.withColumns({"_w": F.filter(F.split(text, _SPACE), lambda w: w != ""), "_l": F.filter(F.split(text, "\n"), spoken), "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")})
    n = F.size("_w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    counted = cut_up.withColumns({"n_words": n.cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_h": windows}).drop("_w", "_l")
    repeated = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(_covered(F.col("_h")))
    return counted.withColumn("n_repeat_words", repeated.cast("long")).drop("_h")


def with_terms(df: DataFrame) -> DataFrame:
    """Adds base_failed, the language and source keys, and the vector of ``TERMS``."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    return df.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "k_source": F.concat(F.lit("s"), lang, F.lit("\u0000"), source), "k_lang": F.concat(F.lit("l"), lang),
        "x0": F.log1p("n_words"), "x1": F.col("word_chars") / words, "x2": F.sqrt(F.col("n_symbols") / letters),
        "x3": F.sqrt(F.col("n_dup_lines") / lines), "x4": F.sqrt(F.col("n_repeat_words") / words),
    })


def _joined(rows: DataFrame, table: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if groups <= BROADCAST_GROUPS else table, "key", how)


def _small(table: DataFrame, groups: int) -> DataFrame:
    """A table of a row or a few for each group, stored in few parts: it is read in every step."""
    return cut(table, max(1, groups // TASK_GROUPS))


def _distance() -> Column:
    """Squared Mahalanobis distance: forward substitution through the Cholesky factor's columns c_ij."""
    def extended(i: int):
        return lambda y: F.array(*(F.get(y, F.lit(j)) for j in range(i)), (F.col(TERMS[i]) - F.col(f"m{i}") - reduce(lambda a, j: a + F.col(f"c{i}{j}") * F.get(y, F.lit(j)), range(i), F.lit(0.0))) / F.col(f"c{i}{i}"))

    solved = F.array().cast("array<double>")
    for i in range(len(TERMS)):
        solved = _let(solved, extended(i))
    return F.aggregate(solved, F.lit(0.0), lambda a, y: a + y * y)


def _estimate(kept: DataFrame) -> DataFrame:
    """key, start, means m_i, Cholesky columns c_ij of the covariance (floors added) and log determinant of each group; rows are centred
    on o_i."""
    d = range(len(TERMS))
    apart = [F.col(TERMS[i]) - F.col(f"o{i}") for i in d]
    sums = [F.avg(apart[i]).alias(f"a{i}") for i in d] + [F.avg(apart[i] * apart[j]).alias(f"p{i}{j}") for i in d for j in d if j <= i]
    table = kept.groupBy("key", "start").agg(*sums, *(F.first(f"o{i}").alias(f"o{i}") for i in d))
    for i in d:
        for j in range(i + 1):
            spread = F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            rest = reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}"), range(j), spread)  # noqa: B023
            table = table.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"c{j}{j}"))
    size = reduce(lambda a, i: a + F.ln(f"c{i}{i}"), d, F.lit(0.0))
    return table.select("key", "start", *(f"o{i}" for i in d), *((F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in d), *(f"c{i}{j}" for i in d for j in range(i + 1)), (2 * size).alias("log_det"))


class Rules:
    """Estimated groups: which key each source has, and each key's centre, covariance and scale."""

    def __init__(self, keys: DataFrame, table: DataFrame, groups: int, sources: int):
        self.keys, self.table, self.groups, self.sources = keys, table, groups, sources

    def judge(self, rows: DataFrame) -> DataFrame:
        """Adds kept to rows that have base_failed, k_source and the terms."""
        keyed = rows.join(F.broadcast(self.keys) if self.sources <= BROADCAST_GROUPS else self.keys, "k_source", "left")
        judged = _joined(keyed, self.table, self.groups, "left")
        far = _distance() > F.col("scale") * CUTOFF
        return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def _quantile(column: Column | str, share: float) -> Column:
    return F.percentile_approx(column, share, ACCURACY)


def _reached(rows: DataFrame, far: str, share: float, columns: list[str]) -> DataFrame:
    """The groups' own ``columns``, which their rows carry, with reach: the quantile of column ``far``. One table then has all that the next pass joins."""
    by = [c for c in ("key", "start") if c in columns]
    return rows.groupBy(by).agg(_quantile(far, share).alias("reach"), *(F.first(c).alias(c) for c in columns if c not in by))


def _stepped(keyed: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """One concentration step of every group and start in ``table``; to be stored by the caller."""
    apart = _joined(keyed, table, groups).withColumn("far", _distance())
    reach = _small(_reached(apart, "far", SUBSET, table.columns), groups)
    return _estimate(_joined(keyed, reach, groups).where(_distance() <= F.col("reach")))


def concentrated(keyed: DataFrame, groups: int) -> DataFrame:
    """The estimate of each key from rows (key, ``TERMS``): m_i, c_ij, log_det, the start it came from, and whether it settled."""
    d = range(len(TERMS))
    medians = _small(keyed.groupBy("key").agg(*(_quantile(TERMS[i], 0.5).alias(f"o{i}") for i in d)), groups)
    around = _joined(keyed, medians, groups)
    scales = (F.greatest(1.4826 * _quantile(F.abs(F.col(TERMS[i]) - F.col(f"o{i}")), 0.5), F.lit(FLOORS[i])).alias(f"c{i}{i}") for i in d)
    centred = _small(around.groupBy("key").agg(*scales, *(F.first(f"o{i}").alias(f"o{i}") for i in d)), groups)
    flat = {f"c{i}{j}": F.lit(0.0) for i in d for j in range(i)}
    first = centred.withColumns({f"m{i}": F.col(f"o{i}") for i in d} | flat | {"start": F.lit(STARTS[0]), "log_det": F.lit(0.0)})
    worst = F.greatest(*(F.abs(F.col(TERMS[i]) - F.col(f"o{i}")) / F.col(f"c{i}{i}") for i in d))
    reach = _small(_reached(_joined(keyed, centred, groups).withColumn("worst", worst), "worst", 0.5, centred.columns), groups)
    near = _joined(keyed, reach, groups).where(worst <= F.col("reach")).withColumn("start", F.lit(STARTS[1]))
    half = _joined(keyed, centred, groups).where(F.pmod(F.xxhash64(*TERMS), F.lit(2)) == 0).withColumn("start", F.lit(STARTS[2]))
    table = _small(_estimate(near).unionByName(_estimate(half)).unionByName(first, allowMissingColumns=True), groups)
    for _ in range(TRIAL):
        table = _small(_stepped(keyed, table, groups), groups)
    place = F.array_position(F.array(*map(F.lit, STARTS)), F.col("start"))
    table = _small(table.groupBy("key").agg(F.min_by(F.struct(*table.columns[1:]), F.struct("log_det", place)).alias("b")).select("key", "b.*"), groups)
    done = []
    for _ in range(MOST_STEPS - TRIAL):
        after = _stepped(keyed, table, groups)
        # an estimate that didn't get better is kept; the groups that moved go on alone
        both = after.join(table.select("key", F.struct(*table.columns[1:]).alias("was")), "key").withColumn("falls", F.col("was.log_det") - F.col("log_det"))
        better = F.when(F.col("falls") > 0, F.struct(*table.columns[1:])).otherwise(F.col("was"))
        both = _small(both.select("key", better.alias("b"), (F.col("falls") > SETTLED).alias("moves")).select("key", "b.*", "moves"), groups)
        done.append(both.where("not moves").drop("moves"))
        table = both.where("moves").drop("moves")
        if not table.limit(1).count():
            break
    return _small(reduce(DataFrame.unionByName, [d.withColumn("settled", F.lit(True)) for d in done], table.withColumn("settled", F.lit(False))), groups)


def estimate(rows: DataFrame) -> Rules:
    """Rules from rows with terms (read several times: pass a stored table)."""
    d = range(len(TERMS))
    sources = cut(rows.groupBy("k_source", "k_lang").agg(F.count("*").alias("n")))
    n_sources, n_rows = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sources = sources.coalesce(max(1, n_sources // TASK_GROUPS))
    pools = sources.where(F.col("n") < LEAST).groupBy("k_lang").agg(F.sum("n").alias("pool"))
    keys = _small(sources.join(pools, "k_lang", "left").select("k_source", F.when(F.col("n") >= LEAST, F.col("k_source")).when(F.col("pool") >= LEAST, F.col("k_lang")).otherwise(ALL).alias("key")), n_sources)
    n_groups = keys.select("key").distinct().count()
    keyed = rows.join(F.broadcast(keys) if n_sources <= BROADCAST_GROUPS else keys, "k_source").select("key", *TERMS)
    if keys.where(F.col("key") == ALL).limit(1).count():
        keyed = keyed.where(F.col("key") != ALL).unionByName(rows.select(F.lit(ALL).alias("key"), *TERMS))
    keyed = cut(keyed, max(1, n_rows // TASK_ROWS))
    table = concentrated(keyed, n_groups)
    reach = _small(_joined(keyed, table, n_groups).withColumn("far", _distance()).groupBy("key").agg(_quantile("far", 0.5).alias("reach")), n_groups)
    scaled = F.greatest(F.col("reach") / MEDIAN, F.lit(1.0)).alias("scale")
    final = table.join(reach, "key").select("key", *(f"m{i}" for i in d), *(f"c{i}{j}" for i in d for j in range(i + 1)), scaled, "settled")
    return Rules(keys, _small(final, n_groups), n_groups, n_sources)


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    rows = cut(with_terms(with_counts(documents.select("doc_id", "text", "lang", "source"))).drop("text", "lang", "source", "n_lines"))
    return estimate(rows).judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns. Rows and terms are stored once; estimating reads the terms alone."""
    counted = stored(with_terms(with_counts(documents.select(F.struct("*").alias("row"), "text", "lang", "source"))).select("row", "base_failed", "k_source", "k_lang", *TERMS))
    return estimate(counted.select("k_source", "k_lang", *TERMS)).judge(counted).where("kept").select("row.*")
