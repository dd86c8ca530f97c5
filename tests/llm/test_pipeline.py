"""The pipeline's stages against plain versions on the smallest tables."""

import re

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as cp  # noqa: E402

from vigil.llm import exact_dedup, near_dedup, toxicity  # noqa: E402

from tests.llm.test_decontaminate import plain  # noqa: E402
from tests.llm.test_near_dedup import bag, exact, roots  # noqa: E402

PATH = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{PATH}/labels.parquet"))
    auto = lexicon.automaton()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if lexicon.score(toxicity.features(toxicity.fold(r[1] or ""), auto, lexicon.exceptions)[0]) < 0.5]
    same = {}
    for d, t in rows:
        same.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d, t))
    rows = sorted((d, t) for _, d, t in map(min, same.values()))
    bags = [bag(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 0.8 <= min(sum(bags[i].values()), sum(bags[j].values())) / max(1, sum(bags[i].values()), sum(bags[j].values())) and exact(bags[i], bags[j]) >= 0.8]
    top = roots(range(len(rows)), links)
    rows = [r for i, r in enumerate(rows) if top[i] == i]
    bad = {d for d, _, _ in plain(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()])}
    want = {d for d, _ in rows} - bad
    found = cp.run(spark, PATH)
    assert {r.doc_id for r in found.collect()} == want
    assert [c for c, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "bpe"]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(60)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, PATH).columns == docs.columns
        assert stage(spark, docs.limit(0), PATH).count() == 0


def test_narrow_tables_take_few_files(spark, tmp_path, monkeypatch):
    """As many files as the rows need, not as many as a shuffle has partitions: each file costs its executor processes, which hold its memory for a moment."""
    from vigil.llm import common

    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    own = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        own.conf.set(k, v)
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    near_dedup.keep_one(own.read.parquet(f"{PATH}/documents.parquet")).count()
    exact_dedup.drop_copies(own.read.parquet(f"{PATH}/documents.parquet")).count()
    files = {}
    for p in (tmp_path / "vigil").iterdir():
        files.setdefault(p.name.rsplit("-", 1)[0], []).append(len(list(p.glob("part-*"))))
    for tag in ("sizes", "members", "stars", "roots", "classes", "kept"):
        assert max(files[tag]) <= -(-docs.count() * near_dedup.BANDS // common.FILE_ROWS), (tag, files[tag])


def test_workers_return_memory():
    """What a partition freed is not held on to, even below a block that lives on."""
    from vigil.llm.common import returned

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    kept = []

    def run(batches):
        most = [bytes([k % 255 + 1]) * 100_000 for k in range(3000)]
        kept.append(bytes([1]) * 100_000)
        yield resident()
        del most

    before = resident()
    (peak,) = returned(run)(iter([]))
    assert peak > before + 200 and resident() < before + 100
