"""Exact deduplication against a dictionary, with a digest that collides, and over several micro-batches."""

import hashlib
import re

from pyspark.sql import functions as F

from vigil.llm import exact_dedup

ROWS = [(5, "a b", "x"), (3, "ab", "y"), (4, "a  b", "z"), (9, "a  b", None), (9, "a  b", None), (1, None, "q"), (2, " \n", "q"), (7, "", "q"), (8, "AB", "x"), (None, "zz", "x"), (6, "z z", None), (11, "z z", "w"), (12, "x" * 100_000, "w"), (13, "a c", "v"), (14, "ac", "v")]


def expected(rows):
    groups = {}
    for i, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def got(docs, digest=exact_dedup.sha256):
    found = exact_dedup.classes(docs, digest).select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("sha"))
    return sorted([tuple(r) for r in found.collect()], key=str)


def test_classes_and_collisions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").coalesce(1)
    assert got(docs) == expected(ROWS)
    weak = got(docs, lambda t: F.encode(F.substring(t, 1, 1), "UTF-8"))  # "ab" and other texts share it
    assert [r[:4] for r in weak] == [r[:4] for r in expected(ROWS)] or sorted(r[:4] for r in map(lambda r: tuple(map(str, r)), weak)) == sorted(tuple(map(str, r[:4])) for r in expected(ROWS))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in expected(ROWS))
    assert exact_dedup.classes(docs.limit(0)).count() == 0


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, x string").coalesce(1)
    weak = lambda t: F.encode(F.substring(t, 1, 1), "UTF-8")
    for digest in (exact_dedup.sha256, weak):
        seen = exact_dedup.arrivals(docs, digest).collect()
        source, out, checkpoint = (str(tmp_path / f"{digest.__name__}-{x}") for x in ("in", "out", "check"))
        schema = exact_dedup.arrivals(docs, digest).schema
        for k in range(3):
            spark.createDataFrame(seen[k::3], schema).coalesce(1).write.mode("append").parquet(source)
            exact_dedup.start_stream(source, schema, out, checkpoint, spark).awaitTermination()
        state = {bytes(r.digest): (r.best.keep_id, r.group_size) for r in exact_dedup.state_table(spark, out).collect()}
        bad = {bytes(r.digest) for r in spark.read.parquet(f"{out}/differing").collect()}
        if digest is weak:
            texts = {}
            for r in seen:
                texts.setdefault(bytes(r.digest), set()).add(r.norm)
            assert bad == {d for d, t in texts.items() if len(t) > 1} and bad
        else:
            assert not bad and state == {bytes.fromhex(r[4]): (r[1], r[2]) for r in expected(ROWS)}


def test_very_long_text(spark):
    rows = [(1, "ab " * 1_000_000, None), (2, "ab" * 1_000_000, None), (3, "ab" * 999_999, "x")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string, at string").coalesce(1)) == expected(rows)
