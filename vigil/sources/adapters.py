"""The driver's tables as telemetry: spans, metric samples, logs, and a long signal table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Unix seconds of a timestamp without zone."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are root spans of their customer's segment, line items their children of the part's type."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, part = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    roots = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("trace_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("span_id"),
        F.lit("").alias("parent_span_id"),
        F.col("c_mktsegment").alias("service_name"),
        (F.col("o_totalprice") / 1e5).alias("duration_s"),
        seconds("o_orderdate").alias("start_time_s"),
        F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("OK").alias("status_code"),
        F.col("o_orderpriority").startswith("1").alias("is_retry"),
    )
    children = items.join(part, items.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("span_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_span_id"),
        F.col("p_type").alias("service_name"),
        (F.col("l_extendedprice") / 1e5).alias("duration_s"),
        seconds("l_shipdate").alias("start_time_s"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status_code"),
        (F.col("l_linestatus") == "O").alias("is_retry"),
    )
    return roots.unionByName(children)


SPANS = """spans AS (
  SELECT o_orderkey::VARCHAR AS trace_id, 'o' || o_orderkey AS span_id, '' AS parent_span_id, c_mktsegment AS service_name, o_totalprice / 1e5 AS duration_s,
    epoch_us(o_orderdate) / 1e6 AS start_time_s, CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE 'OK' END AS status_code, o_orderpriority LIKE '1%' AS is_retry
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT l_orderkey::VARCHAR, concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'o' || l_orderkey, p_type, l_extendedprice / 1e5,
    epoch_us(l_shipdate) / 1e6, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END, l_linestatus = 'O'
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric samples: service, pod, ts, value, is_error, limit_value."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("svc"), (F.col("user_id") % 6).cast("string")).alias("service"),
        F.col("user_id").alias("pod"),
        seconds("ts").alias("ts"),
        "value",
        (F.col("event_type") == "error").alias("is_error"),
        "event_type",
        F.get_json_object("props", "$.k").cast("double").alias("limit_value"),
    )


SAMPLES = """samples AS (
  SELECT event_id, 'svc' || (user_id % 6) AS service, user_id AS pod, epoch_us(ts) / 1e6 AS ts, value, event_type = 'error' AS is_error, event_type, json_extract_string(props, '$.k')::DOUBLE AS limit_value
  FROM events
)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log records, with a level from their labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    level = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "warning").otherwise("")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("service_name"), F.col("lang").alias("pod_name"), F.col("text").alias("body"), F.coalesce(level, F.lit("")).alias("level"))


LOGS = """logs AS (
  SELECT d.doc_id, source AS service_name, lang AS pod_name, text AS body, CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'warning' ELSE '' END AS level
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long signal: episode (user), t (day of the month from 0), service (event type), value (mean, or null without events)."""
    events = table(spark, sf_dir, "events")
    cells = events.groupBy(F.col("user_id").alias("episode_id"), (F.dayofmonth("ts") - 1).alias("t"), F.col("event_type").alias("service")).agg(F.round(F.avg("value"), 6).alias("value"))
    episodes = events.select(F.col("user_id").alias("episode_id")).distinct()
    services = events.select(F.col("event_type").alias("service")).distinct()
    grid = episodes.join(F.broadcast(services)).select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("t"), "service")
    return grid.join(cells, ["episode_id", "t", "service"], "left")


SIGNAL = """cells AS (
  SELECT user_id AS episode_id, day(ts)::INT - 1 AS t, event_type AS service, round(avg(value), 6) AS value FROM events GROUP BY ALL
), signal AS (
  SELECT e.episode_id, g.t::INT AS t, s.service, c.value
  FROM (SELECT DISTINCT user_id AS episode_id FROM events) e, (SELECT DISTINCT event_type AS service FROM events) s, range(0, 31) g(t)
  LEFT JOIN cells c ON c.episode_id = e.episode_id AND c.t = g.t AND c.service = s.service
)"""
