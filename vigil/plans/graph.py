"""Service-graph queries."""

from pyspark.sql import functions as F

from vigil.operators import graph as G
from vigil.operators.windows import on_ticks
from vigil.plans.registry import query
from vigil.sources.adapters import SPANS, seconds, spans, table

CALLS = (
    SPANS
    + """, calls AS (
  SELECT p.service_name AS src, c.service_name AS dst, c.duration_s, c.status_code, c.start_time_s, c.trace_id
  FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.parent_span_id <> '' AND p.service_name <> c.service_name
), edges AS (
  SELECT src, dst, count(*) AS volume, median(duration_s) AS latency_median_s, avg(CASE WHEN status_code = 'ERROR' THEN 1.0::DOUBLE ELSE 0 END) AS error_rate FROM calls GROUP BY ALL
), nodes AS (SELECT DISTINCT service_name AS node FROM spans)"""
)


def _edges(spark, d):
    return G.edges(G.call_edges(spans(spark, d)))


def _nodes(spark, d):
    return spans(spark, d).select(F.col("service_name").alias("node")).distinct()


def rounded(df, *columns):
    """Medians of quotients can lie half-way at six digits, so latencies keep nine."""
    return df.withColumns({c: F.round(c, 9 if c == "latency_median_s" else 6) for c in columns})


@query(f"WITH {CALLS} SELECT src, dst, volume, round(latency_median_s, 9) AS latency_median_s, round(error_rate, 6) AS error_rate FROM edges")
def service_graph_edges(spark, d):
    return rounded(_edges(spark, d), "latency_median_s", "error_rate")


@query(f"""WITH {CALLS}, m AS (SELECT *, trunc(start_time_s / 2592000)::BIGINT AS bin FROM calls)
SELECT bin, src, dst, count(*) AS volume, round(median(duration_s), 9) AS latency_median_s, round(avg(CASE WHEN status_code = 'ERROR' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate
FROM m GROUP BY ALL HAVING count(*) > 2""")
def service_graph_binned(spark, d):
    calls = G.call_edges(spans(spark, d)).withColumn("bin", F.floor(F.col("start_time_s") / 2592000))
    return rounded(G.edges(calls, ("bin",), 2), "latency_median_s", "error_rate")


DAY, START, TICKS = 86400.0, 694224000.0, 120  # from 1992-01-01


@query(f"""WITH {CALLS}
SELECT k AS tick, src, dst, count(*) AS volume, round(median(duration_s), 9) AS latency_median_s, round(avg(CASE WHEN status_code = 'ERROR' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate
FROM calls JOIN range(0, {TICKS}) g(k) ON start_time_s BETWEEN {START} + k * {20 * DAY} - {45 * DAY} AND {START} + k * {20 * DAY} GROUP BY ALL""")
def service_graph_windowed(spark, d):
    """Sliding graphs: closed windows of 45 days every 20 days."""
    calls = on_ticks(G.call_edges(spans(spark, d)), "start_time_s", START, 20 * DAY, 45 * DAY, TICKS)
    return rounded(G.edges(calls, ("tick",)), "latency_median_s", "error_rate")


@query(f"""WITH {CALLS} SELECT a.node AS src, b.node AS dst, coalesce(volume, 0) AS volume, round(coalesce(latency_median_s, 0), 9) AS latency_median_s, round(coalesce(error_rate, 0), 6) AS error_rate
FROM nodes a CROSS JOIN nodes b LEFT JOIN edges e ON e.src = a.node AND e.dst = b.node""")
def graph_adjacency_dense(spark, d):
    return rounded(G.dense(_edges(spark, d), _nodes(spark, d)), "latency_median_s", "error_rate")


@query(f"WITH {CALLS} SELECT a.node AS src, b.node AS dst, CASE WHEN volume IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS a FROM nodes a CROSS JOIN nodes b LEFT JOIN edges e ON e.src = a.node AND e.dst = b.node")
def graph_adjacency_binary(spark, d):
    return G.dense(_edges(spark, d), _nodes(spark, d)).select("src", "dst", (F.col("volume") > 0).cast("double").alias("a"))


NORM = """, full_m AS (SELECT a.node AS src, b.node AS dst, coalesce(volume, 0)::DOUBLE + CASE WHEN a.node = b.node THEN 1 ELSE 0 END AS a FROM nodes a CROSS JOIN nodes b LEFT JOIN edges e ON e.src = a.node AND e.dst = b.node),
deg AS (SELECT src, CASE WHEN sum(a) > 0 THEN 1 / sqrt(sum(a)) ELSE 0 END AS h FROM full_m GROUP BY src),
norm AS (SELECT m.src, m.dst, m.a * x.h * y.h AS a FROM full_m m JOIN deg x ON x.src = m.src JOIN deg y ON y.src = m.dst)"""


@query(f"WITH {CALLS} {NORM} SELECT src, dst, round(a, 6) AS a FROM norm")
def graph_adjacency_normalised(spark, d):
    return rounded(G.normalised(G.dense(_edges(spark, d), _nodes(spark, d)), "volume"), "a")


@query(f"WITH {CALLS} SELECT src, dst, round(latency_median_s, 9) AS latency FROM edges")
def graph_channel_latency(spark, d):
    return _edges(spark, d).select("src", "dst", F.round("latency_median_s", 9).alias("latency"))


@query(f"""WITH {CALLS} {NORM}, f AS (SELECT service_name AS node, avg(duration_s) AS value FROM spans GROUP BY ALL)
SELECT src AS node, 'duration' AS feature, round(sum(a * value), 6) AS value FROM norm JOIN f ON f.node = norm.dst GROUP BY ALL""")
def gcn_propagate(spark, d):
    features = spans(spark, d).groupBy(F.col("service_name").alias("node")).agg(F.avg("duration_s").alias("value")).withColumn("feature", F.lit("duration"))
    return rounded(G.propagate(G.normalised(G.dense(_edges(spark, d), _nodes(spark, d)), "volume"), features), "value")


@query(f"""WITH {CALLS}, k AS (SELECT node, (SELECT count(*) FROM edges WHERE src = node) AS k FROM nodes),
n AS (SELECT count(*) AS n_nodes, avg(k) AS degree_mean, max(k) AS degree_max FROM k),
e AS (SELECT count(*) AS n_edges, sum(volume)::BIGINT AS volume, avg(latency_median_s) AS latency_mean, avg(error_rate) AS error_mean FROM edges)
SELECT n_nodes, round(degree_mean, 6) AS degree_mean, degree_max, n_edges, volume, round(latency_mean, 6) AS latency_mean, round(error_mean, 6) AS error_mean, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM n, e""")
def graph_stats_basic(spark, d):
    return rounded(G.stats(_edges(spark, d), _nodes(spark, d)), "degree_mean", "latency_mean", "error_mean", "density")


LINKS = "links AS (SELECT DISTINCT 'c' || c_nationkey AS a, 's' || s_nationkey AS b FROM customer, supplier WHERE c_custkey = s_suppkey)"
WALK = f"""WITH RECURSIVE {LINKS}, both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(a, b, d) AS (SELECT a, a, 0 FROM both_ UNION SELECT w.a, e.b, w.d + 1 FROM walk w JOIN both_ e ON w.b = e.a WHERE w.d < 50),
dist AS (SELECT a, b, min(d)::INT AS d FROM walk GROUP BY a, b)"""


def _links(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    joined = c.join(s, c.c_custkey == s.s_suppkey)
    return joined.select(F.concat(F.lit("c"), "c_nationkey").alias("a"), F.concat(F.lit("s"), "s_nationkey").alias("b")).distinct()


@query(f"{WALK} SELECT a, b, d FROM dist")
def graph_distances(spark, d):
    return G.distances(_links(spark, d))


@query(f"{WALK} SELECT a AS node, min(b) AS component FROM dist GROUP BY a")
def graph_weak_components(spark, d):
    return G.components(_links(spark, d))


@query(f"""{WALK}, c AS (SELECT a AS node, min(b) AS component FROM dist GROUP BY a),
top AS (SELECT component, count(*) AS n FROM c GROUP BY ALL ORDER BY n DESC, component LIMIT 1)
SELECT top.component, any_value(n) AS size, max(d) AS diameter FROM top JOIN c USING (component) JOIN dist ON dist.a = c.node GROUP BY ALL""")
def graph_diameter(spark, d):
    dist = G.distances(_links(spark, d))
    comps = G.components(_links(spark, d)).withColumnRenamed("node", "a")
    top = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "component").limit(1)
    return top.join(comps, "component").join(dist, "a").groupBy("component", "size").agg(F.max("d").alias("diameter"))


@query(f"""WITH {CALLS}, big AS (SELECT * FROM edges WHERE volume > 20), known AS (SELECT node FROM nodes WHERE node <> 'BUILDING'), ends AS (SELECT src AS node FROM big UNION SELECT dst FROM big)
SELECT 'isolated' AS rule, node AS entity FROM known WHERE node NOT IN (SELECT node FROM ends)
UNION ALL SELECT 'phantom', node FROM ends WHERE node NOT IN (SELECT node FROM known)
UNION ALL SELECT 'missing', node FROM (VALUES ('BUILDING'), ('NOWHERE')) v(node) WHERE node NOT IN (SELECT node FROM known)
UNION ALL SELECT 'low_volume', src || '>' || dst FROM big WHERE volume < 40""")
def graph_validation_report(spark, d):
    known = _nodes(spark, d).where("node <> 'BUILDING'")
    expected = spark.createDataFrame([("BUILDING",), ("NOWHERE",)], "node string")
    return G.violations(_edges(spark, d).where("volume > 20"), known, expected, 40)


@query(f"""WITH {SPANS}, kids AS (SELECT trace_id, parent_span_id AS span_id, count(*) AS k FROM spans WHERE parent_span_id <> '' GROUP BY ALL),
seen AS (SELECT trace_id, span_id, 1 AS depth FROM spans WHERE parent_span_id = '' UNION ALL SELECT c.trace_id, c.span_id, 2 FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.parent_span_id = ''),
t AS (SELECT s.trace_id, max(depth) AS depth, avg(coalesce(k, 0)) AS fan_out FROM seen s LEFT JOIN kids USING (trace_id, span_id) GROUP BY ALL)
SELECT DISTINCT s.trace_id, coalesce(depth, 0) AS depth, round(coalesce(fan_out, 0), 6) AS fan_out FROM spans s LEFT JOIN t USING (trace_id)""")
def trace_depth_fanout(spark, d):
    return rounded(G.trace_structure(spans(spark, d)), "fan_out")


@query(f"""WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY start_time_s, duration_s, service_name) AS n FROM spans)
SELECT service_name, count(*) AS n, round(sum(duration_s), 3) AS total FROM r WHERE n = 1 GROUP BY ALL""")
def span_dedup(spark, d):
    return G.dedup_spans(spans(spark, d)).groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_s"), 3).alias("total"))


ENDS = f"WITH {CALLS}, big AS (SELECT * FROM edges WHERE volume > 20), known AS (SELECT node FROM nodes WHERE node <> 'BUILDING'), ends AS (SELECT src AS node FROM big UNION SELECT dst FROM big)"


def _found(spark, d, rule):
    known = _nodes(spark, d).where("node <> 'BUILDING'")
    none = spark.createDataFrame([], "node string")
    return G.violations(_edges(spark, d).where("volume > 20"), known, none, 0).where(F.col("rule") == rule).select(F.col("entity").alias("node"))


@query(f"{ENDS} SELECT node FROM known WHERE node NOT IN (SELECT node FROM ends)")
def graph_isolated_nodes(spark, d):
    """Known services that no edge of enough volume touches."""
    return _found(spark, d, "isolated")


@query(f"{ENDS} SELECT node FROM ends WHERE node NOT IN (SELECT node FROM known)")
def graph_phantom_edges(spark, d):
    """Ends of edges that are no known service."""
    return _found(spark, d, "phantom")
