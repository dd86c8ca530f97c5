"""The shards of the query hold the library's ids."""

import numpy as np
import public_tokenizers
import sentencepiece

from vigil.llm import training_order as to

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_ids(spark, tmp_path):
    rows = [(i, "The café's\n\n  %d words, " % i * (i % 23)) for i in range(90)] + [(90, None), (91, ""), (92, "\n"), (93, "  "), (94, "a▁b 日本語 \t🙂\n"), (95, " lead\n trail \n")]
    source, path = str(tmp_path / "docs"), f"file://{tmp_path}/shards"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(source)
    got = to.write(spark.read.parquet(source), path, length=32, per_shard=50, key=5, model=MODEL).collect()
    body, found = dict(to.read(path)), {}
    for r in sorted((r for r in got if r.slot is not None), key=lambda r: (r.doc_id, r.seq)):
        assert r.shard == r.slot // 50 and r.offset // 64 == r.slot % 50 and len(body[r.slot]) == 64
        found.setdefault(r.doc_id, []).extend(np.frombuffer(body[r.slot][r.offset % 64 :][: 2 * r.n_ids], "<u2").tolist())
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert found == {i: ids for i, t in rows if (ids := pieces.encode(t or ""))}
    assert {r.doc_id for r in got if r.slot is None} == {i for i, t in rows if not pieces.encode(t or "")}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    n = {}
    for r in to.op5_training_order(spark, "/root/testdata/sf0.001").collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n_ids
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert n == {i: len(pieces.encode(t or "")) for i, t in docs.items()}
