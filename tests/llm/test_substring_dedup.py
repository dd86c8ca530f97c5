"""Removal of repeated passages against brute force, with small windows and with a sketch that lets everything through."""

import hashlib
import random
import re
from collections import Counter

import pytest

from vigil.llm import substring_dedup as sd


def brute(rows, size):
    seen = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = [sd.LAST if i is None else i for i, _ in rows]
    for p, ws in zip(place, split, strict=True):
        for k in range(len(ws) - size + 1):
            key = tuple(ws[k : k + size])
            seen[key] = min(seen.get(key, p), p)
    out = []
    for (i, _), p, ws in zip(rows, place, split, strict=True):
        gone = set()
        for k in range(len(ws) - size + 1):
            if seen[tuple(ws[k : k + size])] < p:
                gone |= set(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "width"), [(20, 1 << 40), (17, 1), (20, None)])
def test_against_brute_force(spark, size, width):
    rng = random.Random(size)
    words = ["w%d" % k for k in range(40)] + ["é ü", "🙂"]
    passage = [rng.choice(words) for _ in range(70)]
    rows = [(None, " ".join(passage)), (3, None), (4, ""), (5, "a\tb\n c"), (5, " ".join(passage[:30]))]
    for i in range(10, 60):
        ws = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(60)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[a : a + rng.randrange(5, 60)]
        rows.append((i, "  ".join(ws)))
    rows += [(70, rows[20][1]), (70, rows[20][1]), (71, rows[20][1].replace("  ", "\n")), (72, "x " * 3000), (73, "x " * 2500), (74, "y " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, cleaned = sd.remove_repeats(docs, size, width)
    kept = {(r.place, r.th): r for r in cleaned.collect()}
    got = []
    for r in found.collect():
        c = kept.get((r.place, r.th))
        n, sha = (r.n_words, hashlib.sha256(b"").hexdigest()) if r.whole else (c.n_removed, hashlib.sha256(c.kept.encode()).hexdigest()) if c else (0, r.sha.hex())
        got.append((r.doc_id, r.n_words, n, sha))
    assert sorted(got, key=str) == brute(rows, size)


def test_empty_table(spark):
    found, cleaned = sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string, extra int"))
    assert found.count() == 0 and cleaned.count() == 0


def test_sketch_is_never_too_low(spark):
    rng = random.Random(9)
    anchors = [k for k in range(4000) for _ in range(rng.choice([1, 1, 1, 1, 2, 5]))]
    found = spark.createDataFrame([(a,) for a in anchors], "anchor long")
    repeated = sum(n > 1 for n in Counter(anchors).values())
    for width, most in ((sd.width_for(len(anchors)), 0.1), (512, 1.0), (1, 1.0)):
        r = sd.over_count(found, width).first()
        assert (r.anchors, r.repeated) == (4000, repeated) and repeated <= r.taken <= repeated + most * (4000 - repeated)
        assert sd.sketch(found, width).count() <= sd.ROWS * width
