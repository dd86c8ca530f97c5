"""Service graphs from spans, and their algebra. Spans are keyed by (trace_id, span_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.sources.stored import stored


def call_edges(spans: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """One row for each call between two services: a span joined to its parent. Roots, missing parents and calls inside a service drop out, as do services outside the list."""
    if services is not None:
        spans = spans.join(services.select("service_name"), "service_name", "left_semi")
    parent = spans.select(F.col("trace_id"), F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("src"))
    child = spans.where(F.col("parent_span_id") != "").select("trace_id", "parent_span_id", F.col("service_name").alias("dst"), "duration_s", "status_code", "start_time_s")
    return child.join(parent, ["trace_id", "parent_span_id"]).where("src <> dst")


def edges(calls: DataFrame, keys: tuple[str, ...] = (), threshold: int = 0) -> DataFrame:
    """Volume, median latency and error rate of each edge with more than `threshold` calls."""
    found = calls.groupBy(*keys, "src", "dst").agg(
        F.count(F.lit(1)).alias("volume"), F.median("duration_s").alias("latency_median_s"), F.avg((F.col("status_code") == "ERROR").cast("double")).alias("error_rate")
    )
    return found.where(F.col("volume") > threshold)


def dense(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """All ordered pairs of the (few, bounded by the service catalogue) nodes, absent edges as zero."""
    pairs = nodes.select(F.col("node").alias("src")).join(nodes.select(F.col("node").alias("dst")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("volume", "latency_median_s", "error_rate")]
    return pairs.join(edges_, ["src", "dst"], "left").select("src", "dst", *zero)


def normalised(matrix: DataFrame, weight: Column | str, loops: bool = True) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 with zero for nodes of degree zero. matrix: all pairs of src and dst."""
    a = (F.col(weight) if isinstance(weight, str) else weight).cast("double") + (F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0) if loops else F.lit(0.0))
    rows = matrix.select("src", "dst", a.alias("a"))
    degree = rows.groupBy("src").agg(F.sum("a").alias("d"))
    half = degree.select("src", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("h"))
    return rows.join(half, "src").join(half.select(F.col("src").alias("dst"), F.col("h").alias("k")), "dst").select("src", "dst", (F.col("a") * F.col("h") * F.col("k")).alias("a"))


def propagate(matrix: DataFrame, features: DataFrame) -> DataFrame:
    """A x features: matrix (src, dst, a), features (node, feature, value)."""
    joined = matrix.join(features, matrix.dst == features.node)
    return joined.groupBy("src", "feature").agg(F.sum(F.col("a") * F.col("value")).alias("value")).withColumnRenamed("src", "node")


def stats(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, density, mean and largest out-degree, volume, means of latency and error rate."""
    degrees = nodes.join(edges_.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k")), "node", "left").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg(F.coalesce("k", F.lit(0))).alias("degree_mean"), F.max(F.coalesce("k", F.lit(0))).alias("degree_max"))
    totals = edges_.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("volume").alias("volume"), F.avg("latency_median_s").alias("latency_mean"), F.avg("error_rate").alias("error_mean"))
    density = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    return degrees.join(F.broadcast(totals)).withColumn("density", density)


def reach(edges_: DataFrame) -> DataFrame:
    """All pairs (a, b) that a path of one or more edges joins, with the least number of edges d, over a graph of a catalogue's size. edges_: a, b. Known paths are joined to one another, so their length doubles each round, until nothing changes; cycles end."""
    now = stored(edges_.select("a", "b").distinct().withColumn("d", F.lit(1)), "paths")
    mark = None
    while (new := tuple(now.agg(F.count(F.lit(1)), F.sum("d")).first())) != mark:
        mark = new
        longer = now.join(now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("e")), "b").select("a", F.col("c").alias("b"), (F.col("d") + F.col("e")).alias("d"))
        now = stored(now.unionByName(longer).groupBy("a", "b").agg(F.min("d").alias("d")), "paths")
    return now


def distances(links: DataFrame) -> DataFrame:
    """Shortest undirected distances between the nodes of a small graph that a path joins. links: a, b."""
    both = links.select("a", "b").union(links.select("b", "a"))
    return reach(both).select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("d")).alias("d"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of an undirected graph of any size. Each round takes the least label among a node and its neighbours, then the label of that label, so long chains need few rounds."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
    now, changed = stored(now, "labels"), 1
    while changed:
        near = both.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = stored(least.join(jump, "label").select("node", "old", F.least("label", "further").alias("component")), "labels")
        changed = new.where("old <> component").limit(1).count()
        now = new.drop("old")
    return now


def trace_structure(spans: DataFrame) -> DataFrame:
    """Depth (a root has 1) and mean fan-out of each trace, over spans that a root reaches. A level is one equi-join with the one before it, which is stored; levels end when none is left, and a cycle has no root."""
    kept = spans.select("trace_id", "span_id", "parent_span_id")
    child = kept.where("parent_span_id <> ''")
    level, depth = stored(kept.where("parent_span_id = ''").select("trace_id", "span_id"), "level"), 1
    seen = level.withColumn("depth", F.lit(1))
    while level.limit(1).count():
        depth += 1
        level = stored(child.join(level.withColumnRenamed("span_id", "parent_span_id"), ["trace_id", "parent_span_id"]).select("trace_id", "span_id"), "level")
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
    kids = child.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("kids"))
    visited = seen.join(kids, ["trace_id", "span_id"], "left")
    found = visited.groupBy("trace_id").agg(F.max("depth").alias("depth"), F.avg(F.coalesce("kids", F.lit(0))).alias("fan_out"))
    return spans.select("trace_id").distinct().join(found, "trace_id", "left").select("trace_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("fan_out", F.lit(0.0)).alias("fan_out"))


def violations(edges_: DataFrame, nodes: DataFrame, expected: DataFrame, low_volume: int) -> DataFrame:
    """Rows (rule, entity) for isolated nodes, edges to unknown nodes, missing expected services and low volumes."""
    ends = edges_.select(F.col("src").alias("node")).union(edges_.select(F.col("dst").alias("node"))).distinct()
    rows = [
        nodes.join(ends, "node", "left_anti").select(F.lit("isolated").alias("rule"), F.col("node").alias("entity")),
        ends.join(nodes, "node", "left_anti").select(F.lit("phantom").alias("rule"), F.col("node").alias("entity")),
        expected.join(nodes, "node", "left_anti").select(F.lit("missing").alias("rule"), F.col("node").alias("entity")),
        edges_.where(F.col("volume") < low_volume).select(F.lit("low_volume").alias("rule"), F.concat_ws(">", "src", "dst").alias("entity")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def first_service(spans: DataFrame) -> DataFrame:
    """The service a trace is credited to: that of its first span by time and id."""
    return spans.groupBy("trace_id").agg(F.min_by("service_name", F.struct("start_time_s", "span_id")).alias("service_name"))


def dedup_spans(spans: DataFrame) -> DataFrame:
    """The first span of each (trace_id, span_id), by start, duration and service."""
    order = W.partitionBy("trace_id", "span_id").orderBy("start_time_s", "duration_s", "service_name")
    return spans.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
