"""Document fingerprints: SpotSigs, on DataFrame functions only.

A text's words are its runs of letters and digits, lower-cased. An anchor is one of the ``ANCHORS``, very common words of four
languages; its signature is the anchor with the ``CHAIN`` content words that follow it (anchors are passed over). The text's end
shortens a chain. Lists, code and other languages have few anchors; so that every text has signatures all along, content words begin chains as
well (written ``^``): the first one of a text, and every one whose own hash is a multiple of ``SHARE``. That depends on the word alone, so an edit
changes the signatures that it touches and no others. The fingerprint is the set of the signatures' 64-bit hashes, written in ascending
order; the likeness of two is the Jaccard coefficient of their sets.

``similar`` finds the rows like those of a query table: sets are partitioned by their size, so that only sizes that can reach the
threshold meet, and within a partition they meet on their rarest signatures alone, as many as a pair over the threshold cannot all
miss; then the sets are compared. ``edited_likeness`` compares pairs that its contract fixes, so nothing is left to search or prune there.

``with_successors`` needs each document's successor. Spark sorts the documents' keys (doc_id and a hash of the text) into ranges; each
range's first key is a row of a broadcast array, documents go to their range, and the first ones of a range visit the range before it
as well, so that a window within each range sees every successor. No range holds more than its share, unless rows equal in doc_id and
text alone are more.

Edge cases: a null text counts as empty; a text without words has the empty fingerprint, '', and two empty ones have likeness 1;
rows with one doc_id are ordered by a hash of their texts, rows with a null one come first, and doc_id may be of any type that has an
order; the only row of a table is its own successor; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Words that begin a signature, and that chains pass over.
ANCHORS = (
    "the", "of", "to", "is", "a", "an", "and", "in", "that", "it", "for", "on", "was", "be", "with", "as", "by", "at", "are",
    "der", "die", "und", "zu", "das", "den", "ein", "von", "mit", "ist", "de", "la", "que", "le", "et", "les", "des", "du", "un", "une", "est",
    "el", "en", "los", "y", "las", "del", "al",
)
CHAIN = 3
#: One in so many content words begins a chain, by its hash.
SHARE = 4
#: Ranges per shuffle partition; several even out their sizes.
SPREAD = 4
_GLUE = "\u0001"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of a text's signatures.

    Anchors are glued to the content word that follows them, so the text splits into content words, each with the anchors
    before it, and a chain is a slice of that array."""
    none = F.array().cast("array<bigint>")
    plain = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    glued = F.regexp_replace(F.concat(plain, F.lit(" ")), f"(?<![^ ])({'|'.join(ANCHORS)}) ", f"$1{_GLUE}")

    def of_groups(groups: Column) -> Column:
        return _let(F.transform(groups, lambda g: F.substring_index(g, _GLUE, -1)), lambda words: chains(groups, words))

    def chains(groups: Column, words: Column) -> Column:
        def of_group(g: Column, k: Column) -> Column:
            chain = [F.coalesce(F.get(words, k + i), F.lit("")) for i in range(CHAIN)]
            parts = F.split(g, _GLUE)
            begins = (chain[0] != "") & ((k == 0) | (F.pmod(F.xxhash64(chain[0]), F.lit(SHARE)) == 0))  # the last group may be anchors alone
            marks = F.when(begins, F.array(F.lit("^"))).otherwise(F.array().cast("array<string>"))
            return F.transform(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), marks), lambda a: F.xxhash64(a, *chain))

        return F.flatten(F.transform(groups, of_group))

    found = F.sort_array(F.array_distinct(_let(F.split(F.rtrim(glued), " +"), of_groups)))
    return F.when(text.rlike("[\\p{L}\\p{N}]"), found).otherwise(none)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(both / (total - both))


def written(signature_set: Column) -> Column:
    return F.array_join(signature_set.cast("array<string>"), " ")


def _range_of(key: Column, firsts: Column, heads: Column, step: int) -> Column:
    """How many of the ascending keys ``firsts`` are at most ``key``, less one; ``heads`` is every ``step``-th of them."""
    below = lambda values: F.size(F.filter(values, lambda s: s <= key))
    return _let(below(heads), lambda n: (n - 1) * step + below(F.slice(firsts, (n - 1) * step + 1, F.lit(step))) - 1)


def with_successors(documents: DataFrame, value) -> DataFrame:
    """doc_id, text, own = value(text) of every row, with next_text and next_own of the next row by ascending doc_id (the first
    row's after the last)."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.struct("doc_id", F.xxhash64(text).alias("h")).alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the first key of each range of the sorted keys: a row a range
    ranges = rows.select("key").repartitionByRange(SPREAD * parts, "key").withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.min("key").alias("first"))
    firsts = cut(ranges.select("first")).agg(F.sort_array(F.collect_set("first")).alias("firsts"))
    n = firsts.select(F.size("firsts")).first()[0]
    step = max(1, int(n**0.5))
    table = firsts.select("firsts", F.transform(F.sequence(F.lit(1), F.lit(max(1, n)), F.lit(step)), lambda k: F.get("firsts", k - 1)).alias("heads"))
    ranged = rows.join(F.broadcast(table)).withColumn("range", _range_of(F.col("key"), F.col("firsts"), F.col("heads"), step))
    own, visit = F.struct(F.col("range"), F.lit(False).alias("visits")), F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, n))).alias("range"), F.lit(True).alias("visits"))
    dealt = (
        ranged.select("doc_id", "text", "key", F.explode(F.when(F.get("firsts", F.col("range")) == F.col("key"), F.array(own, visit)).otherwise(F.array(own))).alias("at"))
        .select("doc_id", "text", "key", "at.range", "at.visits")
        .repartition(parts, "range")
        .withColumn("own", value(F.col("text")))
    )
    order = Window.partitionBy("range").orderBy("visits", "key")
    return dealt.withColumns({"next_text": F.lead("text").over(order), "next_own": F.lead("own").over(order)}).where("not visits").drop("key", "range", "visits")


def edited_likeness(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the successor's first as many, or all."""
    rows = with_successors(documents, signatures)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.withColumn("of_edited", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def similar(queries: DataFrame, documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_fp, fp, likeness): the distinct non-empty fingerprints of ``documents`` at least ``threshold`` like those of ``queries``.

    Both tables have doc_id and text; the fingerprints lead back to their rows."""
    of = lambda df: df.select(signatures(F.coalesce("text", F.lit(""))).alias("s")).where(F.size("s") > 0).distinct()
    sets, asked = of(documents), of(queries)
    counts = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    size = F.size("s")
    part = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    prefix = size - F.ceil(size * threshold - 1e-9).cast("int") + 1

    def entries(df: DataFrame, parts: Column) -> DataFrame:
        rarity = df.select("s", F.explode("s").alias("sig")).join(counts, "sig", "left").groupBy("s").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sig"))).alias("order"))
        rare = F.slice(F.transform("order", lambda e: e["sig"]), F.lit(1), prefix)
        return rarity.select("s", F.explode(parts).alias("part"), rare.alias("rare")).select("s", "part", F.explode("rare").alias("sig"))

    left = entries(asked, F.array(part - 1, part, part + 1)).withColumnRenamed("s", "q")
    met = left.join(entries(sets, F.array(part)), ["part", "sig"]).select("q", "s").distinct()
    pruned = met.where(F.least(F.size("q"), F.size("s")) >= threshold * F.greatest(F.size("q"), F.size("s")) - 1e-9)
    return pruned.select(written(F.col("q")).alias("query_fp"), written(F.col("s")).alias("fp"), likeness(F.col("q"), F.col("s")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)
