"""Assembly, quality and labels of the signal."""

from pyspark.sql import functions as F

from vigil.operators import sequence as S
from vigil.plans.graph import rounded
from vigil.plans.registry import query
from vigil.sources.adapters import SAMPLES, SIGNAL, samples, signal, table

T0 = 1704067200.0


@query(f"""WITH {SAMPLES}, g AS (SELECT service, bin FROM (SELECT DISTINCT service FROM samples), range(0, 30) r(bin)), m AS (SELECT service, floor((ts - {T0}) / 86400)::BIGINT AS bin, max(value) AS m FROM samples WHERE event_type = 'purchase' GROUP BY ALL),
l AS (SELECT service, floor((ts - {T0}) / 86400)::BIGINT AS bin, avg(is_error::INT) AS l FROM samples WHERE event_type <> 'view' GROUP BY ALL)
SELECT g.service, g.bin::BIGINT AS bin, m, round(l, 6) AS l FROM g LEFT JOIN m USING (service, bin) LEFT JOIN l USING (service, bin)""")
def signal_snapshot_join(spark, d):
    """Modalities aligned on the grid of services and days; what is absent stays missing."""
    rows = samples(spark, d).withColumn("bin", F.floor((F.col("ts") - T0) / 86400))
    grid = rows.select("service").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    m = rows.where("event_type = 'purchase'").groupBy("service", "bin").agg(F.max("value").alias("m"))
    logs = rows.where("event_type <> 'view'").groupBy("service", "bin").agg(F.round(F.avg(F.col("is_error").cast("int")), 6).alias("l"))
    return grid.join(m, ["service", "bin"], "left").join(logs, ["service", "bin"], "left")


@query(f"""WITH {SAMPLES}, a AS (SELECT pod, avg(value) AS x FROM samples WHERE event_type = 'error' AND value > 95 GROUP BY ALL), b AS (SELECT pod, avg(value) AS y FROM samples WHERE event_type <> 'error' GROUP BY ALL)
SELECT pod, round(coalesce(x, y), 6) AS value, x IS NULL AS filled FROM b LEFT JOIN a USING (pod)""")
def signal_fallback_fill(spark, d):
    rows = samples(spark, d)
    a = rows.where("event_type = 'error' AND value > 95").groupBy("pod").agg(F.avg("value").alias("x"))
    b = rows.where("event_type <> 'error'").groupBy("pod").agg(F.avg("value").alias("y"))
    return b.join(a, "pod", "left").select("pod", F.round(F.coalesce("x", "y"), 6).alias("value"), F.col("x").isNull().alias("filled"))


@query(f"""WITH {SAMPLES}, b AS (SELECT pod, min(ts) AS lo, max(ts) AS hi FROM samples GROUP BY ALL)
SELECT pod, CASE WHEN ts < lo + (hi - lo) / 2 THEN 'normal' WHEN ts < lo + (hi - lo) * 0.75 THEN 'injection' ELSE 'recovery' END AS regime, count(*) AS n FROM samples JOIN b USING (pod) GROUP BY ALL""")
def regime_labels(spark, d):
    rows = samples(spark, d)
    b = rows.groupBy("pod").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return rows.join(b, "pod").groupBy("pod", S.regime(F.col("ts"), F.col("lo") + span / 2, F.col("lo") + span * 0.75).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


AUDIT = "audit AS (SELECT episode_id, avg((value IS NULL)::INT) AS nan_ratio, avg((value IS NULL)::INT) FILTER (WHERE service = 'error') AS nan_error, count(*) AS cells FROM signal GROUP BY ALL)"


def _audit(spark, d):
    gone = F.col("value").isNull().cast("int")
    return signal(spark, d).groupBy("episode_id").agg(F.avg(gone).alias("nan_ratio"), F.avg(F.when(F.col("service") == "error", gone)).alias("nan_error"), F.count(F.lit(1)).alias("cells"))


@query(f"WITH {SIGNAL}, {AUDIT} SELECT episode_id, round(nan_ratio, 6) AS nan_ratio, round(nan_error, 6) AS nan_error, cells FROM audit")
def nan_ratio_audit(spark, d):
    return rounded(_audit(spark, d), "nan_ratio", "nan_error")


@query(f"""WITH {SIGNAL}, {AUDIT} SELECT episode_id, concat_ws(';', CASE WHEN nan_ratio > 0.7 THEN 'too_sparse' END, CASE WHEN nan_error > 0.8 THEN 'no_errors' END, CASE WHEN cells <> 155 THEN 'shape' END) AS reasons FROM audit""")
def quality_gate_reasons(spark, d):
    return _audit(spark, d).select("episode_id", S.reasons({"too_sparse": F.col("nan_ratio") > 0.7, "no_errors": F.col("nan_error") > 0.8, "shape": F.col("cells") != 155}).alias("reasons"))


@query(f"""WITH {SIGNAL}, {AUDIT} SELECT episode_id % 10 AS scenario, count(*) AS n, sum((nan_ratio <= 0.7)::INT)::BIGINT AS kept, round(avg(nan_ratio), 6) AS nan_mean, round(max(nan_ratio), 6) AS nan_max FROM audit GROUP BY ROLLUP (episode_id % 10)""")
def scenario_quality_rollup(spark, d):
    rows = _audit(spark, d).withColumn("scenario", F.col("episode_id") % 10)
    return rows.rollup("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("nan_ratio") <= 0.7).cast("int")).alias("kept"), F.round(F.avg("nan_ratio"), 6).alias("nan_mean"), F.round(F.max("nan_ratio"), 6).alias("nan_max"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM o""")
def temporal_split(spark, d):
    """Ranks over all rows come from day counts summed up, not from one sorted partition."""
    rows = table(spark, d, "orders")
    return _ranked(rows).select("o_orderkey", S.temporal_split(F.col("n"), F.col("r"), 0.7, 0.15).alias("split"))


def _ranked(rows):
    from pyspark.sql import Window as W

    days = rows.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("o_orderdate").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a day
    days = days.select("o_orderdate", before.alias("before"), F.sum("k").over(W.partitionBy()).alias("n"))
    inside = F.row_number().over(W.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return rows.join(F.broadcast(days), "o_orderdate").withColumn("r", F.col("before") + inside)


STRATA = """s AS (SELECT *, least(2, greatest(0, n - 1)) AS mt FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus = 'P' AS held, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS r, count(*) OVER (PARTITION BY o_custkey)::INT AS n FROM orders)),
s1 AS (SELECT *, least(1, greatest(0, n - 1 - mt)) AS mv, greatest(1, round_even(n * 0.7, 0)::INT) AS a FROM s), s2 AS (SELECT *, greatest(mv, round_even(n * 0.15, 0)::INT) AS b FROM s1),
s3 AS (SELECT *, CASE WHEN n - a - b < mt THEN greatest(1, a - (mt - (n - a - b))) ELSE a END AS a2 FROM s2), s4 AS (SELECT *, CASE WHEN n - a2 - b < mt THEN greatest(0, n - a2 - mt) ELSE b END AS b2 FROM s3),
strata AS (SELECT o_orderkey, o_custkey, o_orderdate, held, CASE WHEN r <= a2 THEN 'train' WHEN r <= a2 + b2 THEN 'val' ELSE 'test' END AS split FROM s4)"""


def _strata(spark, d):
    from pyspark.sql import Window as W

    own = W.partitionBy("o_custkey")
    rows = table(spark, d, "orders").withColumns({"r": F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")), "n": F.count(F.lit(1)).over(own).cast("int")})
    return rows.withColumn("split", S.stratified_split(F.col("n"), F.col("r"), 0.7, 0.15, 1, 2))


@query(f"WITH {STRATA} SELECT o_orderkey, split FROM strata")
def stratified_temporal_split(spark, d):
    return _strata(spark, d).select("o_orderkey", "split")


@query(f"WITH {STRATA} SELECT o_orderkey, CASE WHEN held AND split IN ('train', 'val') THEN 'test' ELSE split END AS split FROM strata")
def heldout_enforce(spark, d):
    moved = (F.col("o_orderstatus") == "P") & F.col("split").isin("train", "val")
    return _strata(spark, d).select("o_orderkey", F.when(moved, "test").otherwise(F.col("split")).alias("split"))


@query(f"WITH {STRATA} SELECT split, count(*) AS leaks FROM strata WHERE held AND split IN ('train', 'val') GROUP BY ALL")
def heldout_leak_check(spark, d):
    held = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return _strata(spark, d).join(held, "o_orderkey", "left_semi").where(F.col("split").isin("train", "val")).groupBy("split").agg(F.count(F.lit(1)).alias("leaks"))


@query(f"""WITH {STRATA}, b AS (SELECT o_custkey, max(o_orderdate) FILTER (WHERE split = 'train') AS x, min(o_orderdate) FILTER (WHERE split = 'val') AS y, max(o_orderdate) FILTER (WHERE split = 'val') AS z, min(o_orderdate) FILTER (WHERE split = 'test') AS w FROM strata GROUP BY ALL)
SELECT count(*) AS groups, sum((coalesce(x <= y, true) AND coalesce(z <= w, true))::INT)::BIGINT AS in_order FROM b""")
def temporal_split_check(spark, d):
    def at(f, split):
        return f(F.when(F.col("split") == split, F.col("o_orderdate")))

    ends = _strata(spark, d).groupBy("o_custkey").agg(at(F.max, "train").alias("x"), at(F.min, "val").alias("y"), at(F.max, "val").alias("z"), at(F.min, "test").alias("w"))
    ok = F.coalesce(F.col("x") <= F.col("y"), F.lit(True)) & F.coalesce(F.col("z") <= F.col("w"), F.lit(True))
    return ends.agg(F.count(F.lit(1)).alias("groups"), F.sum(ok.cast("int")).alias("in_order"))
