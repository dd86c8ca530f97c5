"""The patterns against plain regular expressions, and Viterbi against all paths."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and pii.luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 019()%é_", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_cases_and_documents():
    cases = ["a@@b.c", "a@b.c@d.e", "x@y.z.@w.v", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "1.2.3.256 001.002.003.0004", "4111 1111 1111 1111", "4111-1111-1111-1111 1234", "+1 (017) 555-7713", "+49++1 234567890", "é" * 9 + "a@b.co", "٣.٣.٣.٣"]
    cases += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for text in cases:
        assert pii.base_spans(text) == plain(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for bias in (0.0, 6.0):
        field = pii.Field(rng.normal(size=(pii.FEATURES, 4)), rng.normal(size=(4, 4)))
        field.emit[: 128, 0] += bias * rng.integers(0, 2, 128)
        sizes = [1, 4, 5, 2, 6]
        features = np.stack([rng.integers(0, s, sum(sizes)) + a for s, a in zip(pii._SIZES, pii._AT, strict=True)], axis=1)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        labels = field.decode(features, first)
        score = field.scores(features, field.emit)
        for lo, size in zip(first, sizes, strict=True):
            best = max(itertools.product(range(4), repeat=size), key=lambda p: sum(score[lo + t, p[t]] for t in range(size)) + sum(field.move[a, b] for a, b in itertools.pairwise(p)))
            assert tuple(labels[lo : lo + size]) == best


def test_field_learns_its_table_and_new_sentences():
    field = pii.train()
    text = "Her name is Petra Vogel and she left.\nSSN: 222-33-4444\nphone: 0171-5550001 today\nThe old house was here. It fell in 1870."
    data = np.frombuffer(text.encode(), np.uint8)
    found = {(k, text[s:e]) for k, s, e in pii.field_spans(data, np.array([0, len(data)]), field)[0]}
    assert found == {("name", "Petra Vogel"), ("number", "222-33-4444"), ("contact", "0171-5550001")}


def test_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é mail a@b.co"), (3, "é mail a@b.co"), (None, "x " * 5000 + "1.2.3.4")], "doc_id long, text string")
    rows = pii.find(docs).collect()
    assert sorted(len(r.base) for r in rows) == [0, 0, 1, 1, 1]
    assert [(s.kind, s.start, s.stop) for r in rows if r.doc_id is None for s in r.base] == [("ip", 10000, 10007)]
    assert pii.find(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_numbers_of_any_length_and_any_count_of_spans(spark):
    long = "0" * 1000 + "999.1.1.1 " + "0" * 1000 + "25.1.1.1"
    assert [k for k, *_ in pii.base_spans(long)] == ["ip"] and pii.base_spans(long)[0][1] == 1010
    starts, reach = [0] + list(range(5, 205)), [1000] + [1000] * 200
    assert pii._meets(starts, reach, 500, 501) and not pii._meets(starts, reach, 1000, 1001) and not pii._meets([], [], 0, 9)
    rows = [(1, None, "x"), (1, None, "x"), (2, "a@b.org", "y")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert sorted((r.doc_id, len(r.base)) for r in found) == [(1, 0), (1, 0), (2, 1)]
