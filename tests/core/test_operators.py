"""Operators on small hand-made inputs."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions import aggregates as A
from vigil.functions import models as M
from vigil.functions import statistics as S
from vigil.functions import text as T
from vigil.operators import drift, graph, sequence, windows
from vigil.sources import dumps, sinks

SPANS = "trace_id string, span_id string, parent_span_id string, service_name string, duration_s double, start_time_s double, status_code string, is_retry boolean"


def spans(spark, rows):
    return spark.createDataFrame([(*r, float(i), "OK", False) if len(r) == 5 else r for i, r in enumerate(rows)], SPANS)


def test_edges_and_depth(spark):
    line = spans(spark, [("t1", "s1", "", "a", 0.5), ("t1", "s2", "s1", "b", 0.3), ("t1", "s3", "s2", "c", 0.1), ("t2", "x", "", "a", 1.0), ("t2", "y", "x", "a", 1.0), ("t3", "q", "gone", "b", 0.1), ("t4", "m", "n", "a", 0.1), ("t4", "n", "m", "b", 0.1)])
    found = {(r.src, r.dst): r.volume for r in graph.edges(graph.call_edges(line)).collect()}
    assert found == {("a", "b"): 2, ("b", "c"): 1, ("b", "a"): 1}
    shape = {r.trace_id: (r.depth, r.fan_out) for r in graph.trace_structure(line).collect()}
    assert shape["t1"] == (3, pytest.approx(2 / 3)) and shape["t2"] == (2, 0.5) and shape["t3"] == (0, 0.0) and shape["t4"] == (0, 0.0)


def test_normalised_isolated_is_identity(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    none = spark.createDataFrame([], "src string, dst string, volume long, latency_median_s double, error_rate double")
    rows = graph.normalised(graph.dense(none, nodes), "volume").collect()
    assert {(r.src, r.dst): r.a for r in rows} == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0}


def test_closed_windows_and_nearest(spark):
    facts = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (30.0,), (-5.0,)], "ts double")
    got = {(r.ts, r.tick) for r in windows.on_ticks(facts, "ts", 0.0, 10.0, 20.0, 4).collect()}
    assert got == {(ts, k) for ts in (0.0, 10.0, 10.1, 30.0, -5.0) for k in range(4) if k * 10 - 20 <= ts <= k * 10}
    series = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 2.0), ("a", 11.0, None)], "k string, ts double, v double")
    got = {r.tick: r.value for r in windows.nearest(series, ["k"], "ts", "v", 0.0, 5.0, 4).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 2.0}  # a tie goes to the earlier one; the last tick's nearest has no value
    assert "NestedLoop" not in windows.on_ticks(facts, "ts", 0.0, 10.0, 20.0, 4)._jdf.queryExecution().toString()


def test_aggregates(spark):
    rows = spark.createDataFrame([(0.1, 10.0), (float("nan"), 30.0), (0.5, 60.0)], "r double, v double")
    got = rows.agg(A.weighted("r", "v").alias("w"), F.max(A.known("r")).alias("m"), F.median(A.known("r")).alias("d")).first()
    assert got.w == pytest.approx(31 / 100) and got.m == 0.5 and got.d == pytest.approx(0.3)
    zero = spark.createDataFrame([(0.2, 0.0), (0.4, 0.0)], "r double, v double")
    assert zero.agg(A.weighted("r", "v").alias("w")).first().w == pytest.approx(0.3)
    assert spark.createDataFrame([(0.01,), (0.02,), (0.5,), (0.99,)], "x double").agg(A.p99("x").alias("p")).first().p == pytest.approx(np.percentile([0.01, 0.02, 0.5, 0.99], 99))
    assert spark.createDataFrame([(0.0,), (0.0,)], "x double").agg(A.variation("x").alias("c")).first().c == 0.0


def test_text(spark):
    rows = spark.createDataFrame([("", "An ERROR here"), ("warning: x", "error"), ("", "all well"), (None, "WARN then fatal")], "l string, b string")
    assert [r.x for r in rows.select(T.level(F.col("l"), F.col("b")).alias("x")).collect()] == ["ERROR", "WARN", "INFO", "ERROR"]
    line = spark.createDataFrame([("2024-01-01T00:00:00Z INFO a User information 42",)], "b string")
    assert line.select(T.tokens(F.col("b")).alias("x")).first().x == ["user", "rmation", "42"]
    assert [r.x for r in spark.createDataFrame([("30s",), ("500ms",), ("1h",), ("2m",), ("x",)], "d string").select(T.duration(F.col("d")).alias("x")).collect()] == [30.0, 0.5, 3600.0, 120.0, None]


def test_windows_of_steps(spark):
    rows = spark.createDataFrame([(1, "s", t, float(t)) for t in range(5)] + [(2, "s", t, 1.0) for t in range(2)], "episode_id int, service string, t int, value double")
    for place, want in (("last", [2, 3, 4]), ("first", [0, 1, 2]), ("middle", [1, 2, 3])):
        got = sequence.window_of(rows, 3, place).orderBy("episode_id", "k").collect()
        assert [r.value for r in got] == [*map(float, want), 0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        sequence.bridge(rows, rows, -1, ["episode_id", "service"])


def test_models():
    assert M.auroc(np.array([1, 2, 3, 4]), np.array([0, 0, 1, 1])) == 1.0 and np.isnan(M.auroc(np.array([1, 2, 3]), np.array([0, 0, 1])))
    assert M.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-5)
    rng = np.random.default_rng(0)
    x = rng.standard_normal(200)
    assert M.mutual_information(x, x + 0.1 * rng.standard_normal(200)) > 1 > M.mutual_information(x, rng.standard_normal(200)) >= 0
    y = np.concatenate([[0.0], x[:-1]]) + 0.1 * rng.standard_normal(200)
    assert M.transfer_entropy(x, y) > M.transfer_entropy(y, x) and M.transfer_entropy(x[:4], y[:4]) == 0.0
    blobs = np.concatenate([rng.normal(c, 0.1, (20, 4)) for c in (0, 3, 6)])
    alone = pd.DataFrame({"leader": range(len(blobs)), "n": 1, "total": list(blobs), "square": (blobs**2).sum(axis=1)})
    table = M.cluster_table(alone, range(2, 6))
    assert table[table.chosen].k.tolist() == [3]
    k, scale = M.weibull(rng.weibull(2.0, 4000) * 3)
    assert abs(k - 2) < 0.15 and abs(scale - 3) < 0.15
    low, high = M.bca(0.5, rng.normal(0.5, 0.1, 500), np.full(20, 0.5))
    assert low < 0.5 < high and M.permutation_p(1.0, np.array([0.0, 2.0, 1.0])) == 0.75


def test_statistics_match_plain_forms(spark):
    rng = np.random.default_rng(3)
    score, y = rng.integers(0, 8, 80), rng.integers(0, 2, 80)
    rows = spark.createDataFrame([("a", int(s), int(t)) for s, t in zip(score, y, strict=True)] + [("b", 1, 1)], "k string, s int, y int")
    got = {r.k: r.auroc for r in S.auroc(rows, ["k"], "s", "y").collect()}
    assert got["a"] == pytest.approx(M.auroc(score, y)) and got["b"] is None
    tests = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04))], "i int, p double")
    assert [r.p_adjusted for r in S.adjust(tests, "p", "i", "holm").orderBy("i").collect()][0] == pytest.approx(0.04)
    assert all(r.p_adjusted == pytest.approx(0.04) for r in S.adjust(tests, "p", "i", "bh").collect())


def test_drift_states():
    sizes, rng = (5, 5, 3), np.random.default_rng(1)
    calm, moved = rng.normal(0, 1, (12, 2)), rng.normal(50, 1, (30, 2))
    series = np.concatenate([calm, moved])
    regime, distance, _ = drift.advance(drift.Watch.new(2), series, 0.2, *sizes)
    assert regime[:12] == ["normal"] * 12 and (distance[:5] == 0).all() and "drift" in regime[12:]
    feel = drift.kernel(2, drift.width(series[:5]))
    onset = regime.index("drift")
    assert distance[onset] == pytest.approx(drift.mmd2(series[:5], series[onset - 4 : onset + 1], *feel)) and distance[onset] >= 0.2
    assert distance[onset + 2] == pytest.approx(drift.mmd2(series[:5], series[onset : onset + 3], *feel))  # the rows since the onset
    back = np.concatenate([calm, moved[:2], calm])
    regime, _, _ = drift.advance(drift.Watch.new(2), back, 0.2, *sizes)
    assert regime.count("recalibrate") == 1
    at = regime.index("recalibrate")
    assert all(r == "normal" for r in regime[at + 1 : at + 4])
    gaps = np.where(rng.random(series.shape) < 0.1, np.nan, series)
    whole = drift.advance(drift.Watch.new(2), gaps, 0.3, *sizes)
    watch, told = drift.Watch.new(2), []
    for lo, hi in ((0, 3), (3, 3), (3, 17), (17, 42)):
        some, _, watch = drift.advance(watch, gaps[lo:hi], 0.3, *sizes)
        told += some
    assert told == whole[0] and (watch.seen, watch.age) == (whole[2].seen, whole[2].age)
    assert drift.mmd2(np.ones((3, 2)), np.ones((3, 2)), *drift.kernel(2, 1.0)) == pytest.approx(0)
    with pytest.raises(ValueError):
        drift.calibrate([np.zeros((3, 2))], 5, 5)
    assert drift.calibrate([rng.normal(size=(30, 2))], 5, 5) > 0


def test_dumps_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"cpu": {"data": {"result": [{"metric": {"pod": "a"}, "values": [[1, "0.5"], [2, "bad"], [3, "NaN"]]}]}}}))
    assert [(r.query, r.labels, r.ts, r.value) for r in dumps.metric_ranges(spark, str(tmp_path / "m.json")).orderBy("ts").collect()] == [("cpu", {"pod": "a"}, 1.0, 0.5), ("cpu", {"pod": "a"}, 2.0, None), ("cpu", {"pod": "a"}, 3.0, None)]
    span = {"traceID": "t", "spanID": "s", "processID": "p", "startTime": 2_000_000, "duration": 500_000, "references": [{"refType": "CHILD_OF", "spanID": "r"}], "tags": [{"key": "error", "value": "true"}]}
    (tmp_path / "t.json").write_text(json.dumps({"traces": [{"traceID": "t", "processes": {"p": {"serviceName": "svc"}}, "spans": [span, span | {"duration": 1}]}]}))
    (got,) = dumps.traces(spark, str(tmp_path / "t.json")).collect()
    assert tuple(got) == ("t", "s", "r", "svc", 0.5, 2.0, "ERROR", False)
    (tmp_path / "l.json").write_text(json.dumps({"streams": [{"stream": {"service_name": "", "app": "web"}, "values": [["1500000000", "hello"], ["x", "no"], ["1"]]}]}))
    (got,) = dumps.logs(spark, str(tmp_path / "l.json")).collect()
    assert tuple(got) == (1.5, "web", "", "hello", "")
    np.savez(tmp_path / "s.npz", signal=np.array([[[1.0, np.nan]]]))
    assert [r.value for r in dumps.signals(spark, str(tmp_path / "s.npz")).orderBy("feature").collect()] == [1.0, None]
    assert dumps.csv_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    triples = spark.createDataFrame([("a b", "p", "c", None), ("a", "w", None, 0.5)], "s string, p string, o string, o_num double")
    sinks.n_triples(triples, str(tmp_path / "nt"), "urn:x:")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "nt")).collect())[1] == "<urn:x:a_b> <urn:x:p> <urn:x:c> ."
    sinks.store(spark.createDataFrame([(1, 2.0)], "episode_id int, v double"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1


def test_long_chains_deep_traces_and_cycles(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("x", "y"), ("y", "x")]
    links = spark.createDataFrame(chain, "a string, b string")
    dist = {(r.a, r.b): r.d for r in graph.distances(links).collect()}
    assert dist["n000", "n040"] == 40 and dist["n040", "n003"] == 37 and dist["n007", "n007"] == 0 and ("x", "n000") not in dist
    assert {r.node: r.component for r in graph.components(links).collect()} == {n: "x" if n in "xy" else "n000" for pair in chain for n in pair}
    ways = {(r.a, r.b): r.d for r in graph.reach(links).collect()}
    assert ways["x", "x"] == 2 and ways["n000", "n040"] == 40 and ("n040", "n000") not in ways
    spans = [("t", f"s{k}", f"s{k - 1}" if k else "") for k in range(40)] + [("t", "lost", "gone"), ("u", "c", "d"), ("u", "d", "c")]
    shape = {r.trace_id: (r.depth, r.fan_out) for r in graph.trace_structure(spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string")).collect()}
    assert shape == {"t": (40, pytest.approx(39 / 40)), "u": (0, 0.0)}


def test_log_text(spark):
    lines = ["[INFO]: ready traceback", "id1234567890 ok", "2024-05-01T10:00:00.123Z WARNING: x disk-full", "\x1b[31mError\x1b[0m no", "took 12.5:30ms, at 10:22 code 0xDEADBEEF deadBEEF99  end"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    found = {r.i: (r.t, r.m) for r in rows.select("i", T.tokens(F.col("line")).alias("t"), T.template(F.col("line")).alias("m")).collect()}
    assert found[0][0] == ["ready", "traceback"] and found[1][0] == ["id", "ok"] and found[2][0] == ["disk-full"] and found[3][0] == ["no"]
    marked = [re.sub(r"\b\d[\d.:,_-]*\b", "<N>", re.sub(r"\b[0-9a-f]{8,}\b", "<H>", x, flags=re.I)) for x in lines]
    assert [found[i][1] for i in range(5)] == [re.sub(r"\s+", " ", x).strip()[:200] for x in marked] and " <N> code 0xDEADBEEF <H> end" in marked[4].replace("  ", " ")


def test_clusters_hold_every_row(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (n, 2)) for c, n in ((0, 70), (3, 20), (9, 10))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>").repartition(4)
    groups = M.gathered(rows, x[[0, 5, 75, 95]], "v").toPandas()
    assert groups["n"].sum() == 100 and np.allclose(np.stack(groups["total"].to_list()).sum(axis=0), x.sum(axis=0))
    table = M.cluster_table(groups, range(2, 4))
    assert table[table.chosen]["k"].tolist() == [3]
    whole = M.inertia(groups["n"].to_numpy(float), np.stack(groups["total"].to_list()), groups["square"].to_numpy(), np.zeros(len(groups), int))
    assert whole == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_clusters_with_empty_partitions(spark):
    x = np.arange(12.0).reshape(6, 2)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>").repartition(1).union(spark.createDataFrame([], "id int, v array<double>"))
    groups = M.gathered(rows, x[[0, 3]], "v").toPandas()  # Spark splits a large file so that some splits hold no row
    assert groups["n"].sum() == 6
