"""Metric, trace and log queries."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.functions import aggregates as A
from vigil.functions import text as T
from vigil.operators.graph import first_service, trace_structure
from vigil.operators.windows import clamped_bin, nearest, on_ticks
from vigil.plans.graph import rounded
from vigil.plans.registry import query
from vigil.sources.adapters import LOGS, SAMPLES, SPANS, logs, samples, spans, table

T0 = 1704067200.0  # 2024-01-01


@query(f"WITH {SAMPLES} SELECT service, max(value) AS peak FROM samples GROUP BY ALL")
def metric_max_over_pods(spark, d):
    return samples(spark, d).groupBy("service").agg(F.max(A.known("value")).alias("peak"))


@query(f"WITH {SAMPLES}, p AS (SELECT service, pod, avg(value) AS used, max(limit_value) AS limit_value FROM samples GROUP BY ALL) SELECT service, round(max(CASE WHEN limit_value > 0 THEN used / limit_value END), 6) AS util FROM p GROUP BY ALL")
def metric_util_ratio_max(spark, d):
    pods = samples(spark, d).groupBy("service", "pod").agg(F.avg("value").alias("used"), F.max("limit_value").alias("limit_value"))
    return pods.groupBy("service").agg(F.round(A.utilisation("used", "limit_value"), 6).alias("util"))


@query(f"""WITH {SAMPLES}, t AS (SELECT service, pod, count(*) AS total FROM samples GROUP BY ALL), e AS (SELECT service, pod, count(*) AS errors FROM samples WHERE is_error GROUP BY ALL),
r AS (SELECT service, total, coalesce(errors, 0) / greatest(total, 1e-9) AS rate FROM t LEFT JOIN e USING (service, pod))
SELECT service, round(CASE WHEN sum(total) = 0 THEN avg(rate) ELSE sum(rate * total) / sum(total) END, 6) AS error_rate FROM r GROUP BY ALL""")
def metric_error_rate_weighted(spark, d):
    rows = samples(spark, d)
    total = rows.groupBy("service", "pod").agg(F.count(F.lit(1)).alias("total"))
    errors = rows.where("is_error").groupBy("service", "pod").agg(F.count(F.lit(1)).alias("errors"))
    rate = total.join(errors, ["service", "pod"], "left").withColumn("rate", F.coalesce("errors", F.lit(0)) / F.greatest(F.col("total").cast("double"), F.lit(1e-9)))
    return rate.groupBy("service").agg(F.round(A.weighted("rate", "total"), 6).alias("error_rate"))


@query(f"WITH {SAMPLES} SELECT service, round(quantile_cont(value, 0.99), 6) AS p99 FROM samples GROUP BY ALL")
def metric_p99_union(spark, d):
    return samples(spark, d).groupBy("service").agg(F.round(A.p99("value"), 6).alias("p99"))


@query(f"WITH {SAMPLES} SELECT service, round(median(value), 6) AS mid FROM samples GROUP BY ALL")
def metric_median(spark, d):
    return samples(spark, d).groupBy("service").agg(F.round(F.median(A.known("value")), 6).alias("mid"))


@query(f"""WITH {SAMPLES}, le AS (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]) AS le), c AS (SELECT service, le, count(*) FILTER (WHERE value <= le) AS cum FROM samples, le GROUP BY ALL),
i AS (SELECT service, le, cum - coalesce(lag(cum) OVER w, 0) AS c, coalesce(lag(le) OVER w, 0) AS lo FROM c WINDOW w AS (PARTITION BY service ORDER BY le)),
t AS (SELECT *, sum(c) OVER (PARTITION BY service) AS total FROM i), k AS (SELECT *, greatest(1, round_even(200 * c / total, 0))::INT AS k FROM t WHERE c > 0),
p AS (SELECT service, lo + (unnest(range(1, k + 1)) - 0.5) / k * (le - lo) AS v FROM k)
SELECT service, round(quantile_cont(v, 0.99), 6) AS p99 FROM p GROUP BY ALL""")
def histogram_p99(spark, d):
    """Cumulative buckets, increments, evenly placed points in each bucket, and their 99th percentile."""
    bounds = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
    counts = samples(spark, d).groupBy("service").agg(*[F.count(F.when(F.col("value") <= b, 1)).alias(f"c{k}") for k, b in enumerate(bounds)])
    cells = counts.select("service", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"c{k}").alias("cum")) for k, b in enumerate(bounds)])).alias("x")).select("service", "x.*")
    w = W.partitionBy("service").orderBy("le")
    inc = cells.select("service", "le", (F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0))).alias("c"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lo"))
    total = F.sum("c").over(W.partitionBy("service"))
    k = F.greatest(F.lit(1), F.bround(200 * F.col("c") / F.col("total"), 0).cast("int"))
    points = inc.withColumn("total", total).where("c > 0").withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    value = F.col("lo") + (F.col("i") - 0.5) / F.col("k") * (F.col("le") - F.col("lo"))
    return points.withColumn("v", value).groupBy("service").agg(F.round(A.p99("v"), 6).alias("p99"))


@query(f"""WITH {SAMPLES}, s AS (SELECT service, pod, ts, event_id, sum(value) OVER (PARTITION BY service, pod ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM samples),
b AS (SELECT service, pod, floor((ts - {T0}) / 86400)::BIGINT AS bin, count(*) AS n, arg_max(total, {{'t': ts, 'e': event_id}}) - arg_min(total, {{'t': ts, 'e': event_id}}) AS delta FROM s GROUP BY ALL)
SELECT service, bin, round(sum(greatest(delta, 0) / 86400), 6) AS rate FROM b WHERE n >= 2 GROUP BY ALL""")
def counter_rate_bins(spark, d):
    total = F.sum("value").over(W.partitionBy("service", "pod").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    rows = samples(spark, d).withColumn("total", total).withColumn("bin", F.floor((F.col("ts") - T0) / 86400))
    at = F.struct("ts", "event_id")
    bins = rows.groupBy("service", "pod", "bin").agg(F.count(F.lit(1)).alias("n"), (F.max_by("total", at) - F.min_by("total", at)).alias("delta")).where("n >= 2")
    return bins.groupBy("service", "bin").agg(F.round(F.sum(F.greatest(F.col("delta"), F.lit(0.0)) / 86400), 6).alias("rate"))


@query(f"""WITH {SAMPLES}, s AS (SELECT service, pod, ts, max(value) AS value FROM samples GROUP BY ALL), g AS (SELECT k, {T0} + k * 21600.0 AS t FROM range(0, 120) g(k)), r AS (SELECT DISTINCT service, pod FROM s)
SELECT r.service, r.pod, k AS tick, (SELECT arg_min(value, {{'d': abs(s.ts - g.t), 't': s.ts}}) FROM s WHERE s.pod = r.pod AND s.service = r.service) AS value FROM r, g""")
def nearest_sample_grid(spark, d):
    rows = samples(spark, d).groupBy("service", "pod", "ts").agg(F.max("value").alias("value"))
    return nearest(rows, ["service", "pod"], "ts", "value", T0, 21600.0, 120)


@query(f"WITH {SAMPLES} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM samples")
def coverage_window(spark, d):
    return samples(spark, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES} SELECT event_type, count(DISTINCT pod) AS series, count(*) AS samples FROM samples GROUP BY ALL")
def series_inventory(spark, d):
    return samples(spark, d).groupBy("event_type").agg(F.countDistinct("pod").alias("series"), F.count(F.lit(1)).alias("samples"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'cart-' || substr(md5(s_suppkey::VARCHAR), 1, 9) || '-' || substr(md5(s_suppkey::VARCHAR), 10, 5) WHEN 1 THEN 'db-' || s_suppkey WHEN 2 THEN 'web-' || substr(md5(s_suppkey::VARCHAR), 3, 5) ELSE 'plain' END AS pod FROM supplier)
SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'named' WHEN regexp_matches(pod, '-[a-f0-9]{8,12}-[a-z0-9]{5}$') THEN regexp_replace(pod, '-[a-f0-9]{8,12}-[a-z0-9]{5}$', '') WHEN regexp_matches(pod, '-[0-9]+$') THEN regexp_replace(pod, '-[0-9]+$', '')
WHEN regexp_matches(pod, '-[a-z0-9]{5}$') THEN regexp_replace(pod, '-[a-z0-9]{5}$', '') ELSE pod END AS service, count(*) AS n FROM s GROUP BY ALL""")
def service_label_infer(spark, d):
    key = F.col("s_suppkey").cast("string")
    pod = (
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("cart-"), F.substring(F.md5(key), 1, 9), F.lit("-"), F.substring(F.md5(key), 10, 5)))
        .when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("db-"), key))
        .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("web-"), F.substring(F.md5(key), 3, 5)))
        .otherwise("plain")
    )
    labels = F.create_map(F.lit("service"), F.when(F.col("s_suppkey") % 7 == 0, "named").otherwise(""))
    rows = table(spark, d, "supplier").select(pod.alias("pod"), labels.alias("labels"))
    return rows.groupBy(T.service_label(F.col("labels"), F.col("pod")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPANS}, kids AS (SELECT trace_id, count(*) AS k FROM spans WHERE parent_span_id <> '' GROUP BY ALL), tr AS (SELECT trace_id, arg_min(service_name, {{'t': start_time_s, 's': span_id}}) AS service_name, max(CASE WHEN parent_span_id = '' THEN 1 ELSE 0 END) AS has_root, count(*) AS n FROM spans GROUP BY ALL),
x AS (SELECT tr.service_name, CASE WHEN has_root = 0 THEN 0 WHEN k IS NULL THEN 1 ELSE 2 END AS depth, CASE WHEN has_root = 0 THEN 0 ELSE coalesce(k, 0) / n END AS fan_out FROM tr LEFT JOIN kids USING (trace_id)),
y AS (SELECT service_name, median(depth) AS depth, median(fan_out) AS fan_out FROM x GROUP BY ALL),
z AS (SELECT service_name, quantile_cont(duration_s, 0.99) AS p99, avg((status_code = 'ERROR')::INT) AS abnormal, avg(is_retry::INT) AS retry, CASE WHEN avg(duration_s) <= 0 THEN 0 ELSE stddev_pop(duration_s) / avg(duration_s) END AS cv FROM spans GROUP BY ALL)
SELECT z.service_name, round(p99, 6) AS p99, round(abnormal, 6) AS abnormal, round(retry, 6) AS retry, round(cv, 6) AS cv, round(coalesce(depth, 0), 6) AS depth, round(coalesce(fan_out, 0), 6) AS fan_out FROM z LEFT JOIN y USING (service_name)""")
def trace_features_service(spark, d):
    rows = spans(spark, d)
    own = rows.groupBy("service_name").agg(A.p99("duration_s").alias("p99"), F.avg((F.col("status_code") == "ERROR").cast("int")).alias("abnormal"), F.avg(F.col("is_retry").cast("int")).alias("retry"), A.variation("duration_s").alias("cv"))
    shape = trace_structure(rows).join(first_service(rows), "trace_id").groupBy("service_name").agg(F.median("depth").alias("depth"), F.median("fan_out").alias("fan_out"))
    return rounded(own.join(shape, "service_name", "left").fillna(0.0, ["depth", "fan_out"]), "p99", "abnormal", "retry", "cv", "depth", "fan_out")


START, STEP, WIDTH, TICKS = 694224000.0, 5184000.0, 7776000.0, 45


def _windowed(name: str, expr: str, extra: str = ""):
    return f"""WITH {SPANS} SELECT k AS tick, service_name, {expr} AS {name} FROM spans JOIN range(0, {TICKS}) g(k) ON start_time_s BETWEEN {START} + k * {STEP} - {WIDTH} AND {START} + k * {STEP} {extra} GROUP BY ALL"""


@query(_windowed("error_rate", "round(avg((status_code = 'ERROR')::INT), 6)"))
def span_error_rate_windowed(spark, d):
    rows = on_ticks(spans(spark, d), "start_time_s", START, STEP, WIDTH, TICKS)
    return rows.groupBy("tick", "service_name").agg(F.round(F.avg((F.col("status_code") == "ERROR").cast("int")), 6).alias("error_rate"))


@query(_windowed("p99", "round(CASE WHEN count(*) >= 2 THEN quantile_cont(duration_s, 0.99) END, 10)", "WHERE duration_s > 0"))
def span_p99_windowed(spark, d):
    rows = on_ticks(spans(spark, d).where("duration_s > 0"), "start_time_s", START, STEP, WIDTH, TICKS)
    return rows.groupBy("tick", "service_name").agg(F.round(F.when(F.count(F.lit(1)) >= 2, A.p99("duration_s")), 10).alias("p99"))


@query(_windowed("n", "count(*)"))
def spans_per_window(spark, d):
    return on_ticks(spans(spark, d), "start_time_s", START, STEP, WIDTH, TICKS).groupBy("tick", "service_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOGS}, c AS (SELECT service_name, CASE WHEN level = 'ERROR' THEN 'ERROR' WHEN level = 'warning' THEN 'WARN' WHEN regexp_matches(coalesce(body, ''), '(?i)\\b(error|critical|fatal|severe|emergency)\\b') THEN 'ERROR' WHEN regexp_matches(coalesce(body, ''), '(?i)\\b(warn|warning)\\b') THEN 'WARN' ELSE 'INFO' END AS lv FROM logs)
SELECT service_name, count(*) AS n, round(avg((lv = 'ERROR')::INT), 6) AS error_rate, round(avg((lv = 'WARN')::INT), 6) AS warn_rate FROM c GROUP BY ALL""")
def log_level_rates(spark, d):
    rows = logs(spark, d).withColumn("lv", T.level(F.col("level"), F.col("body")))
    return rows.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("lv") == "ERROR").cast("int")), 6).alias("error_rate"), F.round(F.avg((F.col("lv") == "WARN").cast("int")), 6).alias("warn_rate"))


def _entropy_sql(tokens: str) -> str:
    return f"""WITH {LOGS}, k AS (SELECT service_name, unnest({tokens}) AS tok FROM logs), c AS (SELECT service_name, tok, count(*) AS c FROM k GROUP BY ALL)
SELECT service_name, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 5) AS entropy FROM c GROUP BY ALL"""


@query(_entropy_sql(r"list_filter(list_transform(string_split_regex(regexp_replace(body, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{10,13}|\[?(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\]?|\x1B\[[0-9;]*m', ' ', 'gi'), '\s+'), lambda x: lower(x)), lambda x: length(x) >= 2)"))
def lexical_entropy(spark, d):
    rows = logs(spark, d).select("service_name", F.explode(T.tokens(F.col("body"))).alias("tok"))
    return T.entropy(rows, ["service_name"], "tok").withColumn("entropy", F.round("entropy", 5))


@query(_entropy_sql("list_transform(regexp_extract_all(body, '[A-Za-z]+'), lambda x: lower(x))"))
def lexical_entropy_alpha(spark, d):
    rows = logs(spark, d).select("service_name", F.explode(T.letters(F.col("body"))).alias("tok"))
    return T.entropy(rows, ["service_name"], "tok").withColumn("entropy", F.round("entropy", 5))


@query(f"""WITH {LOGS} SELECT substring(trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i)\\b[0-9a-f]{{8,}}\\b', '<H>', 'g'), '\\b\\d[\\d.:,_-]*\\b', '<N>', 'g'), '\\s+', ' ', 'g')), 1, 200) AS template, count(*) AS n FROM logs GROUP BY ALL""")
def log_template_counts(spark, d):
    return logs(spark, d).groupBy(T.template(F.col("body")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SAMPLES} SELECT service, greatest(0, least(9, trunc((ts - {T0 + 86400}) / 172800)))::INT AS bin, round(avg(is_error::INT), 6) AS error_rate FROM samples GROUP BY ALL""")
def log_error_rate_bins(spark, d):
    rows = samples(spark, d).withColumn("bin", clamped_bin(F.col("ts"), T0 + 86400, 172800.0, 10))
    return rows.groupBy("service", "bin").agg(F.round(F.avg(F.col("is_error").cast("int")), 6).alias("error_rate"))


@query(f"""WITH {SAMPLES}, s AS (SELECT service, pod, floor((ts - {T0}) / 86400)::BIGINT AS bin, ts, event_id, value, lag(value) OVER (PARTITION BY service, pod, floor((ts - {T0}) / 86400) ORDER BY ts, event_id) AS before FROM samples)
SELECT service, bin, round(sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END), 4) AS increase FROM s GROUP BY ALL""")
def promql_increase(spark, d):
    """The increase of counters in each day with resets: after a fall the new value counts."""
    bin_ = F.floor((F.col("ts") - T0) / 86400)
    before = F.lag("value").over(W.partitionBy("service", "pod", "bin").orderBy("ts", "event_id"))
    rows = samples(spark, d).withColumn("bin", bin_).withColumn("before", before)
    step = F.when(F.col("before").isNull(), 0.0).when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
    return rows.groupBy("service", "bin").agg(F.round(F.sum(step), 4).alias("increase"))


@query(f"""WITH {SAMPLES}, p AS (SELECT * FROM samples WHERE event_type IN ('error', 'view')), have AS (SELECT DISTINCT pod FROM p WHERE event_type = 'error' AND value > 95)
SELECT service, event_type AS source, count(*) AS n FROM p WHERE (event_type = 'error' AND value > 95) OR (event_type = 'view' AND pod NOT IN (SELECT pod FROM have)) GROUP BY ALL""")
def primary_or_fallback(spark, d):
    """Rows of the first query, and those of its fallback for series that the first does not have."""
    rows = samples(spark, d)
    first = rows.where("event_type = 'error' AND value > 95")
    other = rows.where("event_type = 'view'").join(first.select("pod").distinct(), "pod", "left_anti")
    return first.select("service", "event_type").unionByName(other.select("service", "event_type")).groupBy("service", F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))
