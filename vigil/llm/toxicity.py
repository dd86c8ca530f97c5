"""Toxicity scores from a weighted lexicon.

Method: a text is folded (compatibility forms, lower case, look-alike letters, digits and signs that stand for letters,
zero-width characters dropped), and an Aho-Corasick automaton finds the lexicon's entries in it: whole words and beginnings
of words. Each word of the text counts with its heaviest entry, unless an exception phrase covers it. The sum, as it is and
divided by the length, and the number of different entries give the score through a logistic curve.

The lexicon is learnt: entries whose document frequencies among toxic and other labelled rows differ beyond chance, with the
log odds as weights; exception phrases are pairs of neighbouring words that hold an entry and yet are no likelier in toxic
rows than any text. Training uses at most `most` labelled rows, one for each of the doc_ids with the smallest hashes; this
bound is a parameter, TRAIN_ROWS by default. Labels are used for nothing else.

Cases: a null text is empty; a text without entries gets the curve's value at nothing found; without labelled rows every
score is 0; rows with a null label are no training rows; of several labels for one doc_id the highest counts; repeated rows
get equal scores; a null doc_id counts as not held out; other columns are ignored or carried along.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import python_chunks, returned, table, whole_text

#: Labelled rows to learn from, at most.
TRAIN_ROWS = 20_000
#: Letters of the shortest and the longest beginning of a word that can be an entry.
SHORTEST, LONGEST = 4, 12
#: Twice the log-likelihood ratio from which a difference is taken as real.
EVIDENCE = 25.0

# Letters of other scripts that look like Latin ones, and characters that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | dict.fromkeys("​‌‍⁠﻿­"))
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    """Entries (a beginning of a word, or a whole word with a space at its end) with weights, exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    curve: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            word = entry.rstrip(" ")
            old = found.get(word, (len(word), 0.0, 0.0))
            found.add_word(word, (len(word), weight, old[2]) if entry == word else (len(word), old[1], weight))
        if self.weights:
            found.make_automaton()
        return found

    def score(self, values: tuple[float, ...]) -> float:
        if not self.curve:
            return 0.0
        z = self.curve[0] + sum(c * v for c, v in zip(self.curve[1:], values, strict=True))
        return 1 / (1 + exp(-min(max(z, -40.0), 40.0)))


def hits(text: str, automaton) -> Iterator[tuple[int, int, float]]:
    """Start, end and weight of each word of a folded text that has an entry."""
    if not len(automaton):
        return
    at, best = -1, 0.0
    for end, (size, beginning, whole) in automaton.iter(text):
        start = end + 1 - size
        if start and (text[start - 1].isalpha()):
            continue
        weight = max(beginning, whole if end + 1 == len(text) or not text[end + 1].isalpha() else 0.0)
        if not weight:
            continue
        if start != at:
            if at >= 0:
                yield at, _end(text, at), best
            at, best = start, weight
        else:
            best = max(best, weight)
    if at >= 0:
        yield at, _end(text, at), best


def _end(text: str, at: int) -> int:
    return _WORD.match(text, at).end()


def _word_before(text: str, at: int) -> str:
    """The last word that ends before a place."""
    end = at
    while end and not _WORD.match(text[end - 1]):
        end -= 1
    start = end
    while start and _WORD.match(text[start - 1]):
        start -= 1
    return text[start:end]


def neighbours(text: str, start: int, end: int) -> list[tuple[str, str]]:
    """The pairs of words that a word makes with those beside it, however long or far off they are."""
    word, out = text[start:end], []
    if before := _word_before(text, start):
        out.append((before, word))
    if after := _WORD.search(text, end):
        out.append((word, after[0]))
    return out


def features(text: str, automaton, exceptions: set[tuple[str, str]]) -> tuple[tuple[float, ...], int]:
    """Of a folded text: the values that the curve takes, and the number of words found."""
    total, different, n = 0.0, set(), 0
    for start, end, weight in hits(text, automaton):
        if exceptions and any(p in exceptions for p in neighbours(text, start, end)):
            continue
        total += weight
        different.add(text[start:end])
        n += 1
    length = 1 + text.count(" ")
    return (log1p(total), log1p(1000 * total / length), log1p(len(different))), n


def _evidence(all1: int, all0: int) -> F.Column:
    """Twice the log-likelihood ratio of the frequencies n1 of all1 and n0 of all0 against one frequency of both."""
    n1, n0 = F.least("n1", F.lit(all1)), F.least("n0", F.lit(all0))
    n, total = n1 + n0, float(all1 + all0)
    out = F.lit(0.0)
    for seen, of in ((n1, n * all1 / total), (n0, n * all0 / total), (all1 - n1, (total - n) * all1 / total), (all0 - n0, (total - n) * all0 / total)):
        out = out + F.when((seen > 0) & (of > 0), 2 * seen * F.log(seen / of)).otherwise(0.0)
    return out


def longest(real: dict[str, tuple[float, int]]) -> list[str]:
    """Without the beginnings that a longer one replaces (it is in as good as all the same documents), and without whole words that are entries as beginnings. The strongest come first, as they are given."""
    gone = set()
    for entry, (_, n1) in real.items():
        for size in range(len(entry.rstrip(" ")) - 1, SHORTEST - 1, -1):
            if (shorter := entry[:size]) in real and n1 >= 0.95 * real[shorter][1]:
                gone.add(shorter)
        if entry[-1] == " " and entry[:-1] in real:
            gone.add(entry)
    return [e for e in real if e not in gone]


def _word_counts(train: DataFrame) -> DataFrame:
    """Documents of either label that hold a folded word; each partition's words are summed as they come."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones, zeros = Counter(), Counter()

        def out() -> pd.DataFrame:
            words = list(ones.keys() | zeros.keys())
            frame = pd.DataFrame({"word": words, "n1": [ones[w] for w in words], "n0": [zeros[w] for w in words]})
            ones.clear()
            zeros.clear()
            return frame

        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                (ones if toxic else zeros).update(set(_WORD.findall(fold(text))))
                if len(ones) + len(zeros) > 400_000:
                    yield out()
        if ones or zeros:
            yield out()

    return train.mapInPandas(returned(run), "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _phrase_counts(train: DataFrame, weights: dict[str, float]) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Lexicon(weights).automaton()
        ones, zeros = Counter(), Counter()
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                text = fold(text)
                (ones if toxic else zeros).update({p for s, e, _ in hits(text, automaton) for p in neighbours(text, s, e)})
        if both := list(ones.keys() | zeros.keys()):
            yield pd.DataFrame({"first": [p[0] for p in both], "second": [p[1] for p in both], "n1": [ones[p] for p in both], "n0": [zeros[p] for p in both]})

    found = train.mapInPandas(returned(run), "first string, second string, n1 long, n0 long")
    return found.groupBy("first", "second").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Lexicon:
    """Learn from the labelled rows of docs that are not held out."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    train = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    train = train.persist()
    try:
        sizes = train.agg(F.sum(F.col("toxic").cast("long")).alias("all1"), F.count(F.lit(1)).alias("n")).first()
        all1, all0 = sizes.all1 or 0, sizes.n - (sizes.all1 or 0)
        if not all1 or not all0:
            return Lexicon()
        words = _word_counts(train)
        entry = F.explode(
            F.concat(
                F.when(F.length("word") >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring(F.col("word"), F.lit(1), n))).otherwise(F.array().cast("array<string>")),
                F.array(F.concat("word", F.lit(" "))),
            )
        )
        found = words.where("n1 > 0 OR n0 > 0").select(entry.alias("entry"), "n1", "n0").groupBy("entry").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        # a beginning is counted once for each word it is in, so its counts can exceed the documents
        odds = F.log((F.col("n1") + 0.5) / (all1 + 1.0)) - F.log((F.col("n0") + 0.5) / (all0 + 1.0))
        top = found.withColumn("odds", odds).where((F.col("n1") >= 4) & (F.col("odds") > 1.5)).where(_evidence(all1, all0) >= EVIDENCE).orderBy((F.col("odds") * F.sqrt("n1")).desc(), "entry").collect()
        real = {r.entry: (float(r.odds), r.n1) for r in top}
        weights = {e: real[e][0] for e in longest(real)}
        phrases = _phrase_counts(train, weights).where(F.col("n1") / all1 <= F.col("n0") / all0).where("n0 >= 3").where(_evidence(all1, all0) >= 4).collect()
        lexicon = Lexicon(weights, {(r.first, r.second) for r in phrases})
        rows = train.mapInPandas(returned(_features_of(lexicon)), "a double, b double, c double, toxic int").toPandas()
        lexicon.curve = _logistic(rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy(float))
        return lexicon
    finally:
        train.unpersist()


def _features_of(lexicon: Lexicon):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for frame in frames:
            if not len(frame):
                continue
            values = [features(fold(t), automaton, lexicon.exceptions)[0] for t in frame["text"]]
            yield pd.DataFrame(values, columns=["a", "b", "c"]).assign(toxic=frame["toxic"].to_numpy())

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs as a column `row`, with score and n_hits; nothing is shuffled."""
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part, texts in python_chunks(batches, 4 << 20):
            found = [features(fold(t), automaton, lexicon.exceptions) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([lexicon.score(v) for v, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["row", "score", "n_hits"])

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text().alias("text"))
    return given.mapInArrow(returned(run), schema.add("score", "double").add("n_hits", "long"))


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with the columns of docs."""
    return score(docs, lexicon).where(F.col("score") < threshold).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    found = found.select(F.col("row.doc_id").alias("doc_id"), "score", "n_hits")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
