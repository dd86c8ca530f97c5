"""Sequence queries on the long signal."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.operators import sequence as S
from vigil.plans.graph import rounded
from vigil.plans.registry import query
from vigil.sources.adapters import SIGNAL, signal

FILL = """filled AS (SELECT episode_id, t, service, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY episode_id, service ORDER BY t ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (PARTITION BY episode_id, service ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM signal)"""


@query(f"WITH {SIGNAL}, {FILL} SELECT * FROM filled")
def ffill_bfill(spark, d):
    return signal(spark, d).withColumn("value", S.filled())


@query(f"""WITH {SIGNAL}, e AS (SELECT episode_id, service, median(value) AS e FROM signal GROUP BY ALL), g AS (SELECT episode_id % 10 AS scenario, service, median(value) AS g FROM signal WHERE t < 20 GROUP BY ALL), s AS (SELECT service, median(value) AS s FROM signal WHERE t < 20 GROUP BY ALL)
SELECT x.episode_id, t, x.service, round(coalesce(value, e, g, s, 0), 6) AS value FROM signal x LEFT JOIN e USING (episode_id, service) LEFT JOIN g ON g.scenario = x.episode_id % 10 AND g.service = x.service LEFT JOIN s ON s.service = x.service""")
def impute_cascade(spark, d):
    rows = signal(spark, d).withColumn("scenario", F.col("episode_id") % 10)
    return S.cascade(rows, F.col("t") < 20, "scenario").select("episode_id", "t", "service", F.round("value", 6).alias("value"))


@query(f"WITH {SIGNAL}, {FILL} SELECT s.episode_id, s.t, s.service, CASE WHEN s.service IN ('view', 'click') THEN coalesce(f.value, 0) ELSE coalesce(s.value, 0) END AS value FROM signal s JOIN filled f USING (episode_id, t, service)")
def impute_v5(spark, d):
    """Gauges are carried on, the rest is zero."""
    gauge = F.col("service").isin("view", "click")
    return signal(spark, d).withColumn("_f", S.filled()).select("episode_id", "t", "service", F.coalesce(F.when(gauge, F.col("_f")).otherwise(F.col("value")), F.lit(0.0)).alias("value"))


SCALER = "scaler AS (SELECT service, coalesce(avg(value), 0) AS mean, CASE WHEN count(value) < 2 OR stddev_pop(value) <= 1e-12 THEN 1 ELSE stddev_pop(value) END AS scale, count(value) AS n FROM signal WHERE t < 20 GROUP BY ALL)"


@query(f"WITH {SIGNAL}, {SCALER} SELECT service, round(mean, 6) AS mean, round(scale, 6) AS scale, n FROM scaler")
def scaler_fit(spark, d):
    return rounded(S.scaler(signal(spark, d).where("t < 20"), ["service"]), "mean", "scale")


@query(f"WITH {SIGNAL}, {SCALER} SELECT episode_id, t, service, round((coalesce(value, mean) - mean) / scale, 6) AS value FROM signal JOIN scaler USING (service)")
def scaler_transform(spark, d):
    rows = signal(spark, d)
    return S.scaled(rows, S.scaler(rows.where("t < 20"), ["service"]), ["service"]).select("episode_id", "t", "service", F.round("value", 6).alias("value"))


@query(f"""WITH {SIGNAL}, f AS (SELECT episode_id, avg(value) AS m, stddev_pop(value) AS s, count(DISTINCT t) AS n FROM signal WHERE t < 15 GROUP BY ALL)
SELECT episode_id, t, service, round(CASE WHEN n >= 2 THEN (value - m) / (s + 1e-6) ELSE value END, 4) + 0.0 AS value FROM signal LEFT JOIN f USING (episode_id)""")
def instance_norm(spark, d):
    """By the mean and deviation of an episode's normal steps over all of its services; every cell stays."""
    out = S.instance_norm(signal(spark, d), F.col("t") < 15, ["episode_id"])
    return out.select("episode_id", "t", "service", (F.round("value", 4) + 0.0).alias("value"))


def _window_sql(start: str) -> str:
    return f"""WITH {SIGNAL}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, service ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY episode_id, service) AS n FROM signal WHERE value IS NOT NULL),
p AS (SELECT episode_id, service, i - {start} + greatest(8 - n, 0) AS k, value FROM r WHERE i >= {start} AND i - {start} + greatest(8 - n, 0) < 8)
SELECT f.episode_id, f.service, f.k::INT AS k, coalesce(p.value, 0) AS value FROM (SELECT DISTINCT episode_id, service, k FROM r, range(0, 8) g(k)) f LEFT JOIN p USING (episode_id, service, k)"""


@query(_window_sql("greatest(n - 8, 0)"))
def precursor_last_k(spark, d):
    return S.window_of(signal(spark, d).where("value IS NOT NULL"), 8, "last")


@query(_window_sql("0"))
def precursor_first_k(spark, d):
    return S.window_of(signal(spark, d).where("value IS NOT NULL"), 8, "first")


@query(_window_sql("greatest((n - 8) // 2, 0)"))
def precursor_middle_k(spark, d):
    return S.window_of(signal(spark, d).where("value IS NOT NULL"), 8, "middle")


@query(f"""WITH {SIGNAL} SELECT episode_id, t, service, round(0.5 * coalesce(value, 0) + 0.3 * coalesce(lag(value, 2) OVER w, 0) + 0.2 * coalesce(lag(value, 4) OVER w, 0), 8) AS value FROM signal WINDOW w AS (PARTITION BY episode_id, service ORDER BY t)""")
def causal_conv(spark, d):
    order = W.partitionBy("episode_id", "service").orderBy("t")
    return signal(spark, d).withColumn("value", F.round(S.causal_conv(F.col("value"), [0.5, 0.3, 0.2], 2, order), 8))


@query(f"""WITH {SIGNAL}, x AS (SELECT episode_id, service, t, coalesce(value, 0) AS value FROM signal WHERE t < 10), y AS (SELECT episode_id - 1 AS episode_id, service, t, coalesce(value, 0) AS value FROM signal WHERE t >= 20 AND episode_id - 1 IN (SELECT episode_id FROM signal)),
e AS (SELECT episode_id, service, max(t) AS t, arg_max(value, t) AS a FROM x GROUP BY ALL), b AS (SELECT episode_id, service, min(t) AS f, arg_min(value, t) AS b FROM y GROUP BY ALL)
SELECT episode_id, service, t, round(value, 6) AS value, 'a' AS part FROM x WHERE episode_id IN (SELECT episode_id FROM y) UNION ALL SELECT episode_id, service, (e.t + i)::INT, round(a + (b - a) * i / 4, 6), 'bridge' FROM e JOIN b USING (episode_id, service), range(1, 4) g(i)
UNION ALL SELECT y.episode_id, y.service, y.t - f + e.t + 4, round(value, 6), 'b' FROM y JOIN e USING (episode_id, service) JOIN b USING (episode_id, service)""")
def cascade_bridge(spark, d):
    rows = signal(spark, d).select("episode_id", "service", "t", F.coalesce("value", F.lit(0.0)).alias("value"))
    episodes = rows.select("episode_id").distinct()
    right = rows.where("t >= 20").withColumn("episode_id", F.col("episode_id") - 1).join(episodes, "episode_id", "left_semi").select(*rows.columns)
    left = rows.where("t < 10").join(right.select("episode_id").distinct(), "episode_id", "left_semi").select(*rows.columns)
    return rounded(S.bridge(left, right, 3, ["episode_id", "service"]), "value")


ENVELOPE = "env AS (SELECT service, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM signal GROUP BY ALL)"


def _envelope(rows):
    return rows.groupBy("service").agg(F.percentile("value", F.lit(0.01)).alias("p01"), F.percentile("value", F.lit(0.99)).alias("p99"))


@query(f"""WITH {SIGNAL}, {ENVELOPE}, m AS (SELECT episode_id, service, avg(value) AS mu FROM signal WHERE t < 15 GROUP BY ALL),
o AS (SELECT a.episode_id, a.t, a.service, a.value + 0.5 * (coalesce(b.value, mu) - mu) AS value FROM signal a JOIN signal b ON b.episode_id = a.episode_id + 10 AND b.t = a.t AND b.service = a.service JOIN m ON m.episode_id = b.episode_id AND m.service = b.service)
SELECT episode_id, t, service, round(greatest(least(value, p99), p01), 9) AS value, coalesce(value > p99 OR value < p01, false) AS clipped FROM o JOIN env USING (service) WHERE value IS NOT NULL""")
def overlay_residual(spark, d):
    """An episode plus half of another's departure from its normal mean, inside the envelope."""
    rows = signal(spark, d)
    other = rows.select((F.col("episode_id") - 10).alias("episode_id"), "t", "service", F.col("value").alias("b"))
    mean = rows.where("t < 15").groupBy((F.col("episode_id") - 10).alias("episode_id"), "service").agg(S.ordered_mean().alias("mu"))
    out = rows.join(other, ["episode_id", "t", "service"]).join(mean, ["episode_id", "service"])
    out = out.withColumn("value", F.col("value") + 0.5 * (F.coalesce("b", "mu") - F.col("mu"))).where("value IS NOT NULL")
    return S.clip(out, _envelope(rows), ["service"]).select("episode_id", "t", "service", S.half_away(F.col("value"), 9).alias("value"), "clipped")


@query(f"WITH {SIGNAL}, {ENVELOPE} SELECT service, round(avg((coalesce(value > p99 OR value < p01, false))::INT), 6) AS fraction, round(sum(greatest(least(value, p99), p01)) FILTER (WHERE value IS NOT NULL), 4) AS total FROM signal JOIN env USING (service) GROUP BY ALL")
def clip_envelope(spark, d):
    rows = signal(spark, d)
    return S.clip(rows, _envelope(rows), ["service"]).groupBy("service").agg(F.round(F.avg(F.col("clipped").cast("int")), 6).alias("fraction"), F.round(F.sum("value"), 4).alias("total"))
