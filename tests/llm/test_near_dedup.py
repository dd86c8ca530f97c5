"""Signatures against exact similarity, components against a union-find, and classes against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vigil.llm import near_dedup as nd
from vigil.llm.bagminhash import signatures
from vigil.llm.components import components


def bag(text, size=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)) if len(ws) >= size else Counter([tuple(ws)] if ws else [])


def exact(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(5)
    for _ in range(6):
        a, b = rng.integers(0, 9, 60) * rng.integers(0, 2, 60), rng.integers(0, 9, 60) * rng.integers(0, 2, 60)
        b = np.where(rng.random(60) < 0.6, a, b)
        hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
        owner = np.repeat([0, 1], 60)
        both = np.concatenate([a, b])
        on = both > 0
        sig = signatures(owner[on], np.concatenate([hashes, hashes])[on], both[on], 2, 4000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 5 * (want * (1 - want) / 4000) ** 0.5 + 1e-3
    alone = signatures(np.array([1]), np.array([7], np.uint64), np.array([1]), 3, 125)
    assert (alone[1] > 0).all() and not alone[0].any() and not alone[2].any()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1030)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == roots(nodes, links)


@pytest.mark.parametrize("block", [512, 7])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = [(None, "alone it stands here with some words"), (1, None), (2, ""), (3, "two words"), (4, "two  words"), (4, "two  words"), (5, "a b"), (6, "x " * 500), (7, "x " * 520), (8, "x " * 900)]
    for g in range(6):
        origin = [rng.choice(words) for _ in range(120)]
        for k in range(14):
            text = list(origin)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                text[rng.randrange(120)] = rng.choice(words)
            rows.append((100 + 20 * g + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = nd.classes(docs).collect()
    bags = [bag(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if exact(bags[i], bags[j]) >= 0.8]
    want = Counter()
    top = roots(range(len(rows)), links)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(top[i], []).append((d, t or ""))
    got = {}
    for r in found:
        got.setdefault(r.root, []).append(r)
    assert sorted(sorted(str(r.doc_id) for r in g) for g in got.values()) == sorted(sorted(str(d) for d, _ in g) for g in groups.values())
    for g in got.values():
        assert sum(r.kept for r in g) == 1 and {r.class_size for r in g} == {len(g)}
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.class_id for r in g} == ({min(ids)} if ids else {None})
    kept = nd.keep_one(docs.selectExpr("doc_id", "text", "doc_id AS th", "text AS node"))
    assert kept.columns == ["doc_id", "text", "th", "node"] and kept.count() == len(groups)
    assert not want and nd.classes(docs.limit(0)).count() == 0
