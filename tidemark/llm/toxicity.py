"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding: letters are lower-cased, look-alike letters of other alphabets (``HOMOGLYPHS``) become Latin ones, digits and signs
between or before letters (``DIGITS``) become the letters they stand for, and everything else becomes a space. The lexicon's
entries are beginnings of words (a whole word is one that ends with a space), each with a weight. ``EXCEPTIONS`` are phrases in
which a lexicon word means no harm; a hit within one doesn't count. A text's features are its summed weights per hundred words,
the log of the summed weights, and the number of different entries hit; the score is a logistic function of them.

The lexicon starts with ``BASE`` and is completed from labelled rows: folded word beginnings of 4 to 10 letters that occur in
at least ``SHARE`` of the toxic training texts, and whose odds of being in a toxic text are at least ``ODDS`` times even; of
beginnings found equally often, one within the other, the longest stays. Weights are log odds ratios. At most ``train_rows`` labelled rows are
read, those with the smallest id hashes; counting is a Spark aggregation, and the entries that reach the driver are
bounded by ``SHARE``: at most the mean number of beginnings in a toxic text / ``SHARE``. Long texts are folded and matched in pieces
of ``PIECE`` characters, each with the words around it that a phrase can reach, with the same result as whole.

Edge cases: a null text scores as the empty text, which has no hits; repeated rows score alike; rows with a null id or label
don't train; of rows that share an id one trains; without toxic training rows the lexicon is ``BASE`` alone with default coefficients; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .quality_classifier import held_out
from .shared import cut

TRAIN_ROWS = 16384
SHARE, ODDS = 0.02, 10.0
THRESHOLD = 0.5
MIN, MAX = 4, 10
#: Insults of the four languages, as beginnings of words; a space ends a whole word.
BASE = ("idiot", "moron", "stupid", "scum ", "loser", "imbecil", "pathetic", "worthless", "disgusting", "dumbass", "bastard", "scumbag", "trash ", "clown ", "arschloch", "dummkopf", "connard", "salaud", "gilipollas", "cabron")
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "sore loser", "loser bracket", "pond scum", "disgusting weather")
#: Look-alikes: Cyrillic and Greek letters, full-width letters are folded by rule.
HOMOGLYPHS = dict(zip("аеіјорсухѕԁɡһкмтвнαειορτυχνκ", "aeijopcyxsdghkmtbhaeioptuxvk", strict=True))
DIGITS = dict(zip("01345789@$!|", "oieastbgasil", strict=True))
DEFAULT = np.array([-4.0, 1.0, 0.75, 0.5])
#: Shorter texts count as so many words, so that a single hit in a few words weighs no more than in these.
LEAST_WORDS = 20
PIECE = 1 << 20


@cache
def folding() -> dict[int, str]:
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
    return table


_SIGNS = re.compile(r"[0-9@$!|](?=[^\W\d_])|(?<=[^\W\d_])[0-9@$](?=[^\W_]|[@$])")
_GAPS = re.compile(r"[\W\d_]+")
_BLANK = re.compile(r"\s")


def fold(text: str) -> str:
    """Words of letters, separated and surrounded by single spaces."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(folding())
    if any(c in text for c in DIGITS):
        text = _SIGNS.sub(lambda m: DIGITS.get(m[0], " "), text)
    words = _GAPS.sub(" ", text).strip()
    return f" {words} " if words else " "


def folded(text: str, size: int | None = None) -> Iterator[tuple[str, bool]]:
    """The folded text in parts that end at white space, each with whether it is the last."""
    size, start = size or PIECE, 0
    while start + size < len(text):
        gap = _BLANK.search(text, start + size)
        if not gap:
            break
        yield fold(text[start : gap.start()]), False
        start = gap.end()
    yield fold(text[start:]), True


class Lexicon:
    """Entries with weights, and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], coefficients: np.ndarray = DEFAULT, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.coefficients, self.exceptions = weights, coefficients, exceptions

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(" " + entry, (len(entry) + 1, entry, weight))
        for phrase in self.exceptions:
            word = f" {phrase} "
            found.add_word(word, (len(word), None, 0.0))
        if self.weights or self.exceptions:
            found.make_automaton()
        return found

    def hits(self, text: str, automaton) -> tuple[float, set[str], int]:
        """Summed weights and different entries of the hits outside exceptions, and the number of words."""
        total, entries, words = 0.0, set(), 0
        # a hit, and a phrase that spares it, lie within so many characters of its beginning
        reach = max(map(len, (*self.exceptions, *self.weights)), default=0) + 2
        buffer, done = " ", 0
        for part, last in folded(text):
            buffer += part[1:]
            words += part.count(" ") - 1
            limit = len(buffer) if last else max(done, len(buffer) - reach)
            found: dict[int, tuple[str, float]] = {}
            spared: list[tuple[int, int]] = []
            for end, (size, entry, weight) in automaton.iter(buffer) if len(automaton) else ():
                start = end - size + 1
                if entry is None:
                    spared.append((start, end - 1))  # the space at its end belongs to the next word
                elif done <= start < limit and weight > found.get(start, ("", 0.0))[1]:
                    found[start] = entry, weight  # of entries that begin the same word the heaviest
            spared.sort()
            k, until = 0, -1  # both in ascending order: the furthest end of the phrases begun so far decides
            for start in sorted(found):
                while k < len(spared) and spared[k][0] <= start:
                    until = max(until, spared[k][1])
                    k += 1
                if start > until:
                    total += found[start][1]
                    entries.add(found[start][0])
            cut = max(0, buffer.rfind(" ", 0, max(0, limit - reach) + 1)) if not last else 0
            buffer, done = buffer[cut:], limit - cut
        return total, entries, words

    def features(self, texts: list[str], automaton) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        for r, text in enumerate(texts):
            total, entries, words = self.hits(text, automaton)
            out[r, 1:] = np.log1p(100 * total / max(LEAST_WORDS, words)), np.log1p(total), np.log1p(len(entries))
        return out

    def scores(self, texts: list[str], automaton) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts, automaton) @ self.coefficients, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray = DEFAULT, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards ``start``."""
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * (w - start))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _training(documents: DataFrame, labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(train_rows)
    )
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    return texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # of rows that share an id one trains, however many there are


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Learns entries, weights and coefficients from labelled rows outside the held-out fifth."""

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                for text, y in zip(texts.to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = {w[:n] if n <= len(w) else w + " " for w in set(fold(text).split()) for n in range(MIN, min(MAX, len(w) + 1) + 1) if len(w) >= MIN}
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([y] * len(found), pa.int32())], ["entry", "y"])

    rows = cut(_training(documents, labels, label, train_rows))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    weights = dict.fromkeys(BASE, 3.0)
    if not toxic or not clean:
        return Lexicon(weights)
    n1, n0 = F.sum("y"), F.count("*") - F.sum("y")
    odds = F.log(((n1 + 0.5) / (toxic - n1 + 0.5)) / ((n0 + 0.5) / (clean - n0 + 0.5)))
    learned = (
        rows.select("text", "y").mapInArrow(beginnings, "entry string, y int")
        .groupBy("entry").agg(n1.alias("n1"), n0.alias("n0"), odds.alias("weight"))
        .where((F.col("n1") >= max(3.0, SHARE * toxic)) & ((F.col("n1") + 0.5) / toxic >= ODDS * (F.col("n0") + 0.5) / clean))
    )
    learned = cut(learned)
    # an entry found as often as one a letter longer says no more than that one
    shorter = learned.where(F.length("entry") > MIN).select(F.expr("left(entry, length(entry) - 1)").alias("entry"), "n1", "n0").distinct()
    kept = learned.join(shorter, ["entry", "n1", "n0"], "left_anti").orderBy(F.desc("n1"), F.asc("n0"), F.length("entry"), "entry").collect()
    weights.update((r["entry"], float(r["weight"])) for r in kept)
    lexicon = Lexicon(weights)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                x = lexicon.features(texts.to_pylist(), automaton)
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(x[:, k]) for k in range(4))], ["y", "a", "b", "c", "d"])

    table = rows.select("text", "y").mapInArrow(vectors, "y int, a double, b double, c double, d double").toArrow()
    x = np.stack([table[c].to_numpy() for c in "abcd"], axis=1)
    order = np.lexsort((*x.T, table["y"].to_numpy()))  # sums don't depend on the order of arrival
    return Lexicon(weights, fit(x[order], table["y"].to_numpy()[order].astype(float)))


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lexicon.scores(texts.to_pylist(), automaton))], ["doc_id", "score"])

    rows = documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
