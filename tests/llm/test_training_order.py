"""The permutation is one, and texts come back from the shards."""

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import training_order as to


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**70))
def test_permutation(size, key):
    slots = to.feistel(np.arange(size), size, key)
    assert sorted(slots.tolist()) == list(range(size))
    assert (to.feistel(slots, size, key, inverse=True) == np.arange(size)).all()


def test_keys_differ():
    assert (to.feistel(np.arange(1000), 1000, 1) != to.feistel(np.arange(1000), 1000, 2)).mean() > 0.9


def lay_out(texts, length):
    """Pieces of a partition's documents: (doc, number, sequence, place, ids)."""
    out, at = [], 0
    for d, data in texts:
        for k, start in enumerate(range(at - at % length, at + len(data), length) if data else ()):
            low, high = max(at, start), min(at + len(data), start + length)
            out.append((d, k, start // length, low - start, data[low - at : high - at]))
        at += len(data)
    return out


def test_round_trip(spark, tmp_path):
    rows = [(i, "é%d " % i * (i % 37)) for i in range(200)] + [(7, "x" * 5000), (7, "x" * 5000), (None, "no id"), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).repartition(3)
    source = str(tmp_path / "docs")
    docs.write.parquet(source)
    path = f"file://{tmp_path}/shards"
    given_ = spark.read.parquet(source)
    got = to.write(given_, path, length=64, per_shard=50, key=5).collect()
    parts = {}
    for r in given_.select("doc_id", "text", F.spark_partition_id().alias("part")).collect():
        parts.setdefault(r.part, []).append((r.doc_id, (r.text or "").encode()))
    want, total = [], 0
    for part in sorted(parts):
        laid = lay_out(parts[part], 64)
        want += [(d, k, total + q, place, data) for d, k, q, place, data in laid]
        total += 1 + max((q for _, _, q, _, _ in laid), default=-1)
    slots = to.feistel(np.arange(total), total, 5).tolist()
    body = dict(to.read(path))
    assert sorted(body) == list(range(total)) and all(len(b) == 64 for b in body.values())
    found = sorted((str(r.doc_id), r.seq, r.slot, r.offset - r.slot % 50 * 64, body[r.slot][r.offset % 64 :][: r.n_ids]) for r in got if r.slot is not None)
    assert found == sorted((str(d), k, slots[q], place, data) for d, k, q, place, data in want)
    assert all(r.shard == r.slot // 50 for r in got if r.slot is not None)
    assert {r.doc_id for r in got if r.slot is None} == {0, 37, 74, 111, 148, 185, 300, 301}
    filled = dict.fromkeys(range(total), 0)
    for r in got:
        if r.slot is not None:
            filled[r.slot] += r.n_ids
    assert all(set(body[s][n:]) <= {0} for s, n in filled.items()) and sum(n < 64 for n in filled.values()) <= len(parts)
    assert list(to.read(path, slot=77, count=60)) == [(s, body[s]) for s in range(77, 137)]
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == [f"{k:010d}.bin" for k in range(-(-total // 50))] + ["manifest.json"]
    again = to.write(given_, path, length=64, per_shard=50, key=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and dict(to.read(path)) == body
    assert to.write(given_.limit(0), f"file://{tmp_path}/none").count() == 0
