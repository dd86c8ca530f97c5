"""Marked words against the plain version's templates, and how often a text is worked through."""

import random

from pyspark.sql import functions as F

from tests.llm.test_decontaminate import words
from vigil.llm import decontaminate as dc

PARTS = ["a", "the", "Anna", "anna,", "BOB;", "Rome.", '"Paris"', "(Otto", "5", "$5,", "5,", "3.5a;", "a5", "x-7", "--", ",", ";", "km", "km.", "kmh", "m-long", "hours", "Hours", "İst", "Σ", "ΟΔΟΣ,", "𐐀b", "𐐨;", "𐐨", "𐐀", "😀A", "😀", "é,", "Éa", "ß", "﨎", "", "Anna", "\x01", "\x02b", "\x03km", "\x045", "\x05Eve", "a\x01b", "\x00c", "٣", "字,", "字"]
GAPS = [" "] * 12 + ["  ", "\n", "\t", "\r\n", "\n ", " \n", "\x0b", "\x0c", "\xa0"]


def test_words_in_every_form(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) + rng.choice(GAPS) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["", " ", "\n", "--", *PARTS, *(f" {p}" for p in PARTS), *(f"a, {p} b" for p in PARTS), *(f"5 {p}\n{p}" for p in PARTS)]
    split = [words(t) for t in texts]
    rows = [(i, t, *([w[k] for w in s] for k in range(3))) for i, (t, s) in enumerate(zip(texts, split, strict=True))]
    df = spark.createDataFrame(rows, "doc_id int, text string, fold array<string>, words array<string>, wide array<string>")
    got = dc.forms(df, "doc_id", "text", "fold", "words", "wide")
    for form in ("fold", "words", "wide"):
        bad = got.where(F.col(f"{form}_h") != F.transform(form, lambda w: F.xxhash64(w))).select("text", form, "tokens").limit(3).collect()
        assert not bad, (form, bad)
    assert got.where(F.transform("tokens", dc.folded) != F.col("fold")).count() == 0


def test_a_sign_of_the_own_characters_before_a_name(spark):
    item = "we saw how the small Anna went to the sea with her old dog and then came back home"
    docs = spark.createDataFrame([(1, item.replace("Anna", c + "Karl")) for c in "-\x02"], "doc_id long, text string")
    tokens = {tuple(r.t) for r in docs.select(dc.marked(F.col("text")).alias("m")).select(dc.tokens(F.col("m")).alias("t")).collect()}
    assert tokens == {tuple(item.replace("Anna", dc.WIDE_NAME + "karl").split())}


def test_work_for_each_text(spark):
    """Texts are split once, and no hash stands in a generator, where it would be worked out again wherever the generator names it."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = dc.matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert not any("xxhash64" in line for line in plan.split("\n") if "Generate explode" in line)
