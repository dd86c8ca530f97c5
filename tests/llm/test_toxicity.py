"""Held-out accuracy, scores against a plain version, folding, and odd rows."""

import math
import random
import re

import pytest

from vigil.llm import toxicity


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    found = toxicity.op3_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    assert len(found) > 700 and (found.predicted == found.toxic).mean() > 0.97
    toxic = found[found.toxic == 1]
    assert (toxic.predicted == 1).mean() > 0.85
    assert (found[found.toxic == 0].predicted == 1).mean() < 0.01


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"clown": 3.0, "bad ": 2.0}, {("clown", "fish")}, (-2.0, 1.0, 1.0, 1.0))
    auto = lexicon.automaton()
    assert [text[s:e] for text in [toxicity.fold("A cl0wn, CLОWNs; ｃｌｏｗｎ badly bad uncl​own")] for s, e, _ in toxicity.hits(text, auto)] == ["clown", "clowns", "clown", "bad"]
    assert toxicity.features("a clown fish", auto, lexicon.exceptions)[1] == 0
    assert toxicity.features("a clown here", auto, lexicon.exceptions)[1] == 1
    assert lexicon.score(toxicity.features("", auto, set())[0]) < 0.5 < lexicon.score(toxicity.features("clown bad", auto, set())[0])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "clown", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert not lexicon.curve
    kept = toxicity.reject(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    full = toxicity.Lexicon({"clown": 9.0}, set(), (-1.0, 1.0, 1.0, 1.0))
    assert toxicity.reject(docs, full).count() == 3


def plain_score(text, lexicon):
    """The score word by word: the heaviest entry that a word is or begins with, unless a phrase with a neighbour excepts it."""
    words = re.findall(r"[^\W\d_]+", folded := toxicity.fold(text or ""))
    total, seen = 0.0, set()
    for k, w in enumerate(words):
        weight = max([v for e, v in lexicon.weights.items() if (w == e[:-1] if e[-1] == " " else w.startswith(e))], default=0.0)
        pairs = {(words[k - 1], w)} if k else set()
        pairs |= {(w, words[k + 1])} if k + 1 < len(words) else set()
        if weight and not pairs & lexicon.exceptions:
            total += weight
            seen.add(w)
    values = (math.log1p(total), math.log1p(1000 * total / (1 + folded.count(" "))), math.log1p(len(seen)))
    z = lexicon.curve[0] + sum(c * v for c, v in zip(lexicon.curve[1:], values))
    return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def test_scores_are_those_of_a_plain_version(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    lexicon.exceptions |= {(list(lexicon.weights)[0].strip(), "fish"), ("x" * 60, "clown")}
    lexicon.weights |= {"clown": 3.0, "bad ": 2.0}
    rng = random.Random(2)
    pool = [w.strip() for w in lexicon.weights] + ["fish", "x" * 60, "plain", "words", "--", "9", "badly", "a" * 500]
    rows = [(r.doc_id, r.text) for r in docs.limit(400).collect()] + [(-k, rng.choice([" ", "\n", " ,  ", " " * 90]).join(rng.choices(pool, k=rng.choice([3, 40])))) for k in range(1, 60)]
    rows += [(-100, "clown " * 40_000), (-101, "quiet words " * 100_000 + "clown")]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    for r in toxicity.score(given, lexicon).collect():
        assert r.score == pytest.approx(plain_score(r.row.text, lexicon)), r.row.text[:100]


def test_long_neighbours_and_repeated_ids(spark):
    lexicon = toxicity.Lexicon({"clown": 3.0}, {("x" * 60, "clown")}, (-2.0, 1.0, 1.0, 1.0))
    assert toxicity.features("x" * 60 + " " * 70 + "clown", lexicon.automaton(), lexicon.exceptions)[1] == 0
    docs = spark.createDataFrame([(i, "a nasty clown" if i % 2 else "a kind word") for i in range(200)] + [(1, "a kind word")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    found = toxicity.fit(docs, labels)
    assert {e.strip() for e in found.weights} & {"clown", "nasty", "nast", "clow"} and found == toxicity.fit(docs.distinct(), labels)
    assert not toxicity.fit(docs, labels.limit(0)).curve and not toxicity.fit(docs.limit(0), labels).curve
