"""Episodes: checks and gates, summaries of their signals, counters and gauges in bins, catalogues of services."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.operators.sequence import reasons
from vigil.plans.graph import CALLS, _edges, rounded
from vigil.plans.registry import query
from vigil.sources.adapters import SAMPLES, SIGNAL, SPANS, samples, signal, spans, table
from vigil.plans.telemetry import T0

DAY = 86400.0


def _mean(c):
    """The mean of values with six digits: their sum is rounded to those, which has no halves, and then divided."""
    return F.round(F.sum(c), 6) / F.nullif(F.count(c), F.lit(0))


@query(f"""WITH {SIGNAL}, e AS (SELECT episode_id, max(CASE WHEN value IS NOT NULL THEN t + 1 END) AS steps, avg((value IS NULL)::INT) AS nan_ratio, count(DISTINCT CASE WHEN value IS NOT NULL THEN service END) AS traced FROM signal GROUP BY ALL)
SELECT episode_id, coalesce(steps, 0)::INT AS steps, round(nan_ratio, 6) AS nan_ratio, traced, concat_ws(';', CASE WHEN coalesce(steps, 0) < 20 THEN 'steps' END, CASE WHEN nan_ratio > 0.5 THEN 'nan' END, CASE WHEN traced < 4 THEN 'traced' END) AS reasons FROM e""")
def episode_gate(spark, d):
    """Steps, share of missing cells and services seen of each episode, and the rules that it breaks."""
    known = F.col("value").isNotNull()
    e = signal(spark, d).groupBy("episode_id").agg(F.coalesce(F.max(F.when(known, F.col("t") + 1)), F.lit(0)).cast("int").alias("steps"), F.avg((~known).cast("int")).alias("nan_ratio"), F.countDistinct(F.when(known, F.col("service"))).alias("traced"))
    broken = reasons({"steps": F.col("steps") < 20, "nan": F.col("nan_ratio") > 0.5, "traced": F.col("traced") < 4})
    return e.select("episode_id", "steps", F.round("nan_ratio", 6).alias("nan_ratio"), "traced", broken.alias("reasons"))


@query("SELECT user_id AS episode_id, count(*) AS n_bad, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS bad FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL")
def label_check(spark, d):
    """Labels of each episode that are not on the list of regimes."""
    rows = table(spark, d, "events").where(~F.col("event_type").isin("view", "click", "purchase"))
    return rows.groupBy(F.col("user_id").alias("episode_id")).agg(F.count(F.lit(1)).alias("n_bad"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("bad"))


@query(f"""WITH {SIGNAL}, g AS (SELECT episode_id, t, count(value) AS edges, string_agg(service, ',' ORDER BY service) FILTER (WHERE value IS NOT NULL) AS services FROM signal GROUP BY ALL)
SELECT episode_id, count(*) AS graphs, count(DISTINCT services) AS lists, count(DISTINCT services) <= 1 AS stable, round(avg((edges = 0)::INT), 6) AS empty_ratio, round(avg((edges > 0)::INT), 6) AS full_ratio FROM g GROUP BY ALL""")
def sequence_check(spark, d):
    """Of each episode's graphs: whether the list of services stays, and the shares of graphs without and with an edge."""
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.col("service")))), ",")
    g = signal(spark, d).groupBy("episode_id", "t").agg(F.count("value").alias("edges"), F.nullif(listed, F.lit("")).alias("services"))
    lists = F.countDistinct("services")
    return g.groupBy("episode_id").agg(F.count(F.lit(1)).alias("graphs"), lists.alias("lists"), (lists <= 1).alias("stable"), F.round(F.avg((F.col("edges") == 0).cast("int")), 6).alias("empty_ratio"), F.round(F.avg((F.col("edges") > 0).cast("int")), 6).alias("full_ratio"))


@query(f"WITH {SIGNAL} SELECT episode_id, t, round(avg(coalesce(value, 0)), 6) AS mean FROM signal GROUP BY ALL")
def mean_series(spark, d):
    """The mean over services of each step, missing cells as zero."""
    return signal(spark, d).groupBy("episode_id", "t").agg(F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("mean"))


@query(f"""WITH {SIGNAL}, n AS (SELECT episode_id, max(t) + 1 AS steps FROM signal WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT episode_id % 10 AS pair, min(steps) AS steps FROM n GROUP BY ALL)
SELECT (episode_id % 10)::INT AS pair, t, service, round(sum(coalesce(value, 0)), 6) / count(*) AS mean FROM signal JOIN m ON m.pair = episode_id % 10 WHERE t < m.steps GROUP BY ALL""")
def pair_signal(spark, d):
    """The mean of the episodes of a pair, cut to the shortest of them."""
    rows = signal(spark, d).withColumn("pair", (F.col("episode_id") % 10).cast("int"))
    steps = rows.where("value IS NOT NULL").groupBy("pair", "episode_id").agg((F.max("t") + 1).alias("steps")).groupBy("pair").agg(F.min("steps").alias("steps"))
    return rows.join(steps, "pair").where("t < steps").groupBy("pair", "t", "service").agg(_mean(F.coalesce("value", F.lit(0.0))).alias("mean"))


@query(f"WITH {SIGNAL} SELECT episode_id, service, round(sum(value), 6) / nullif(count(value), 0) AS mean, count(value) AS n FROM signal GROUP BY ALL")
def episode_signature(spark, d):
    return signal(spark, d).groupBy("episode_id", "service").agg(_mean(F.col("value")).alias("mean"), F.count("value").alias("n"))


@query(f"""WITH {SIGNAL}, n AS (SELECT episode_id, max(t) + 1 AS steps FROM signal WHERE value IS NOT NULL GROUP BY ALL)
SELECT s.episode_id, round(sum(value), 6) / nullif(count(value), 0) AS pooled, round(sum(value) FILTER (WHERE service IN ('view', 'click')), 6) / nullif(count(value) FILTER (WHERE service IN ('view', 'click')), 0) AS metrics, round(sum(value) FILTER (WHERE service = 'purchase'), 6) / nullif(count(value) FILTER (WHERE service = 'purchase'), 0) AS traces, round(sum(value) FILTER (WHERE service = 'error'), 6) / nullif(count(value) FILTER (WHERE service = 'error'), 0) AS logs FROM signal s JOIN n USING (episode_id) WHERE t < steps GROUP BY ALL""")
def masked_mean_pool(spark, d):
    """The mean over an episode's valid steps and services, whole and by modality (three services stand for them)."""
    rows = signal(spark, d)
    steps = rows.where("value IS NOT NULL").groupBy("episode_id").agg((F.max("t") + 1).alias("steps"))
    view = {"metrics": ("view", "click"), "traces": ("purchase",), "logs": ("error",)}
    parts = [_mean(F.when(F.col("service").isin(*names), F.col("value"))).alias(k) for k, names in view.items()]
    return rows.join(steps, "episode_id").where("t < steps").groupBy("episode_id").agg(_mean(F.col("value")).alias("pooled"), *parts)


@query(f"WITH {SIGNAL} SELECT episode_id, service, j::INT AS j, value FROM range(0, 8) g(j) JOIN signal ON t = floor(j * 30 / 7.0 + 0.5)")
def time_warp(spark, d):
    """Each series at 8 steps: those nearest to equal parts of its 31."""
    at = spark.range(8).select(F.col("id").cast("int").alias("j"), F.floor(F.col("id") * 30 / 7.0 + 0.5).cast("int").alias("t"))
    return signal(spark, d).join(F.broadcast(at), "t").select("episode_id", "service", "j", "value")


@query(f"""WITH {SIGNAL} SELECT episode_id, t, service, CASE WHEN t < 10 THEN 'normal' WHEN t < 20 THEN 'injection' ELSE 'recovery' END AS regime, CASE WHEN t >= 10 AND t < 20 THEN least(1.0, (t - 10) / 5.0)::DOUBLE ELSE 0.0::DOUBLE END AS intensity, coalesce(value, 0) AS value FROM signal WHERE t >= 10""")
def regime_intensity(spark, d):
    """The steps from the injection on, with their regime and the linear ramp of its intensity; missing values are zero."""
    t = F.col("t")
    regime = F.when(t < 10, "normal").when(t < 20, "injection").otherwise("recovery")
    ramp = F.when((t >= 10) & (t < 20), F.least(F.lit(1.0), (t - 10) / 5.0)).otherwise(0.0)
    return signal(spark, d).where(t >= 10).select("episode_id", "t", "service", regime.alias("regime"), ramp.alias("intensity"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query(f"WITH {CALLS}, w AS (SELECT exp(0.5::DOUBLE) AS a, exp(0.3::DOUBLE) AS b, exp(0.2::DOUBLE) AS c) SELECT src, dst, round((a * volume + b * latency_median_s + c * error_rate) / (a + b + c), 6) AS weight FROM edges, w")
def channel_collapse(spark, d):
    """The three channels of an edge as one, by softmax weights."""
    from math import exp

    a, b, c = (exp(x) for x in (0.5, 0.3, 0.2))
    return _edges(spark, d).select("src", "dst", F.round((a * F.col("volume") + b * F.col("latency_median_s") + c * F.col("error_rate")) / (a + b + c), 6).alias("weight"))


@query(f"WITH {SAMPLES}, p AS (SELECT service, pod, floor((ts - {T0}) / {DAY})::BIGINT AS bin, max(value) AS most FROM samples GROUP BY ALL) SELECT service, bin, round(sum(most), 4) AS total, max(most) AS peak FROM p GROUP BY ALL")
def pod_sums(spark, d):
    """Gauges of a day: the largest value of each pod, their sum and the largest of all, by service."""
    bin_ = F.floor((F.col("ts") - T0) / DAY).alias("bin")
    p = samples(spark, d).groupBy("service", "pod", bin_).agg(F.max("value").alias("most"))
    return p.groupBy("service", "bin").agg(F.round(F.sum("most"), 4).alias("total"), F.max("most").alias("peak"))


@query(f"""WITH {SAMPLES}, b AS (SELECT service, floor((ts - {T0}) / 172800)::BIGINT AS bin, ts, event_id, value FROM samples)
SELECT service, bin, round(avg(value), 6) AS mean, round(arg_max(value, {{'t': ts, 'e': event_id}}) - arg_min(value, {{'t': ts, 'e': event_id}}), 6) AS change FROM b GROUP BY ALL""")
def resample_grid(spark, d):
    """Half-open bins of two days: the mean, and the last value less the first."""
    order = F.struct("ts", "event_id")
    rows = samples(spark, d).withColumn("bin", F.floor((F.col("ts") - T0) / 172800))
    return rows.groupBy("service", "bin").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max_by("value", order) - F.min_by("value", order), 6).alias("change"))


RATES = f"""st AS (SELECT service, pod, event_type AS metric, floor((ts - {T0}) / 432000)::BIGINT AS bin, value, lag(value) OVER (PARTITION BY service, pod, event_type, floor((ts - {T0}) / 432000) ORDER BY ts, event_id) AS before FROM samples),
ra AS (SELECT service, pod, metric, bin, sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) / 432000 AS rate FROM st GROUP BY ALL HAVING count(*) >= 2)"""


def _rates(spark, d):
    """The rate of each series (pod and metric) in windows of five days, with resets, from two points on."""
    bin_ = F.floor((F.col("ts") - T0) / 432000)
    rows = samples(spark, d).select("service", "pod", F.col("event_type").alias("metric"), bin_.alias("bin"), "ts", "event_id", "value")
    rows = rows.withColumn("before", F.lag("value").over(W.partitionBy("service", "pod", "metric", "bin").orderBy("ts", "event_id")))
    step = F.when(F.col("before").isNull(), 0.0).when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
    return rows.groupBy("service", "pod", "metric", "bin").agg((F.sum(step) / 432000).alias("rate"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query(f"WITH {SAMPLES}, {RATES} SELECT service, metric, bin, round(sum(rate), 9) AS rate FROM ra GROUP BY ALL")
def counter_rate_sums(spark, d):
    """Counters as usage, requests, buckets and bytes are read: rates of the series, summed by service."""
    return _rates(spark, d).groupBy("service", "metric", "bin").agg(F.round(F.sum("rate"), 9).alias("rate"))


@query(f"WITH {SAMPLES}, {RATES} SELECT a.service, a.bin, round(sum(a.rate + b.rate), 9) AS iops FROM ra a JOIN ra b ON a.service = b.service AND a.pod = b.pod AND a.bin = b.bin WHERE a.metric = 'view' AND b.metric = 'click' GROUP BY ALL")
def paired_rate_sums(spark, d):
    """Reads and writes: two rates of one series added where both are there, then summed by service."""
    rates = _rates(spark, d)
    writes = rates.where("metric = 'click'").select("service", "pod", "bin", F.col("rate").alias("writes"))
    both = rates.where("metric = 'view'").join(writes, ["service", "pod", "bin"])
    return both.groupBy("service", "bin").agg(F.round(F.sum(F.col("rate") + F.col("writes")), 9).alias("iops"))


@query(f"WITH {SAMPLES}, g AS (SELECT service, pod, event_type AS resource, floor((ts - {T0}) / 432000)::BIGINT AS bin, arg_max(limit_value, {{'t': ts, 'e': event_id}}) AS last FROM samples WHERE limit_value IS NOT NULL GROUP BY ALL) SELECT service, resource, bin, round(sum(last), 4) AS total, count(*) AS pods FROM g GROUP BY ALL")
def gauge_sums(spark, d):
    """Gauges as limits, memory and queues are read: the last value of each pod in a window, summed by service."""
    bin_ = F.floor((F.col("ts") - T0) / 432000).alias("bin")
    g = samples(spark, d).where("limit_value IS NOT NULL").groupBy("service", "pod", F.col("event_type").alias("resource"), bin_).agg(F.max_by("limit_value", F.struct("ts", "event_id")).alias("last"))
    return g.groupBy("service", "resource", "bin").agg(F.round(F.sum("last"), 4).alias("total"), F.count(F.lit(1)).alias("pods"))


@query(f"""WITH {SPANS}, f AS (SELECT DISTINCT service_name AS service, 'spans' AS origin FROM spans UNION SELECT DISTINCT source, 'logs' FROM documents UNION SELECT DISTINCT event_type, 'metrics' FROM events UNION SELECT unnest(['BUILDING', 'view', 'nowhere']), 'configured')
SELECT service, string_agg(origin, ',' ORDER BY origin) AS origins FROM f GROUP BY ALL""")
def service_union(spark, d):
    """All services that spans, logs, metrics or the configuration name, and which of these do."""
    given = spark.createDataFrame([("BUILDING",), ("view",), ("nowhere",)], "service string")
    parts = {"spans": spans(spark, d).select(F.col("service_name").alias("service")), "logs": table(spark, d, "documents").select(F.col("source").alias("service")), "metrics": table(spark, d, "events").select(F.col("event_type").alias("service")), "configured": given}
    out = None
    for origin, rows in parts.items():
        rows = rows.distinct().withColumn("origin", F.lit(origin))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


ALIASES = {"svc0": "front-end", "svc1": "cart-service", "svc2": "front-end"}


@query(f"WITH {SAMPLES} SELECT replace(CASE service WHEN 'svc0' THEN 'front-end' WHEN 'svc1' THEN 'cart-service' WHEN 'svc2' THEN 'front-end' ELSE service END, '-', '_') AS service, count(*) AS n FROM samples WHERE service <> 'svc5' GROUP BY ALL")
def canonical_services(spark, d):
    """Rows by their service's canonical name: aliases rewritten, hyphens as underscores, unknown services dropped."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = spark.createDataFrame([(f"svc{k}",) for k in range(5)], "service string")
    rows = samples(spark, d).join(F.broadcast(known), "service", "left_semi")
    return rows.groupBy(F.replace(F.coalesce(F.try_element_at(names, F.col("service")), F.col("service")), F.lit("-"), F.lit("_")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m(class, source) AS (VALUES ('ASIA', 'a'), ('EUROPE', 'b'), ('MARS', 'c')) SELECT 'class' AS kind, r_name AS name FROM region WHERE r_name NOT IN (SELECT class FROM m) UNION ALL SELECT 'entry', class FROM m WHERE class NOT IN (SELECT r_name FROM region)""")
def mapping_gaps(spark, d):
    """Classes without an entry in the literature mapping, and entries without a class."""
    m = spark.createDataFrame([("ASIA", "a"), ("EUROPE", "b"), ("MARS", "c")], "name string, source string").select("name")
    classes = table(spark, d, "region").select(F.col("r_name").alias("name"))
    return classes.join(m, "name", "left_anti").select(F.lit("class").alias("kind"), "name").unionByName(m.join(classes, "name", "left_anti").select(F.lit("entry").alias("kind"), "name"))


@query("""WITH s(day, split) AS (SELECT k, CASE WHEN k < 20 THEN 'train' ELSE 'val' END FROM range(1, 26) g(k)) SELECT o_orderkey AS episode_id, coalesce(split, '') AS split, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS place FROM orders LEFT JOIN s ON s.day = day(o_orderdate)""")
def dataset_index(spark, d):
    """Episodes with their split (empty if none) and their place among those that start together: sorting by split, start and place sorts the index."""
    split = spark.range(1, 26).select(F.col("id").cast("int").alias("day"), F.when(F.col("id") < 20, "train").otherwise("val").alias("split"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), "o_orderdate", F.dayofmonth("o_orderdate").alias("day")).join(F.broadcast(split), "day", "left")
    return rows.select("episode_id", F.coalesce("split", F.lit("")).alias("split"), F.row_number().over(W.partitionBy("o_orderdate").orderBy("episode_id")).cast("long").alias("place"))


@query("SELECT (o_custkey % 8)::INT AS cluster, string_agg(DISTINCT s_nationkey::VARCHAR, ',' ORDER BY s_nationkey::VARCHAR) AS targets, count(DISTINCT s_nationkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def cluster_targets(spark, d):
    """The targets (of a catalogue's size) of each cluster's scenarios, each once."""
    o, l, s = (table(spark, d, t) for t in ("orders", "lineitem", "supplier"))
    rows = o.join(l, o.o_orderkey == l.l_orderkey).join(s, l.l_suppkey == s.s_suppkey).select((F.col("o_custkey") % 8).cast("int").alias("cluster"), F.col("s_nationkey").cast("string").alias("t"))
    return rows.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("targets"), F.countDistinct("t").alias("n"))


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS sha FROM region""")
def row_sha256(spark, d):
    """The SHA-256 of a row's JSON with sorted keys."""
    return table(spark, d, "region").select("r_regionkey", F.sha2(F.to_json(F.struct("r_name", "r_regionkey")), 256).alias("sha"))


@query("SELECT event_type AS category, (user_id % 10)::INT AS scenario, count(*) AS n FROM events GROUP BY ALL")
def category_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("category"), (F.col("user_id") % 10).cast("int").alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
