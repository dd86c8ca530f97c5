"""Streaming queries over events. Each runs to the end of the table's files; the SQL is of the finished result."""

from pyspark.sql import functions as F

from vigil.plans.registry import query
from vigil.sources.adapters import table
from vigil.streaming import runs as R


LATE = "60 days"


def _events(spark, d):
    """Events as a stream. Rows more than LATE behind the latest one are dropped, and with them goes the state of what they belong to."""
    return R.source(spark, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) / 1000000 AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    w = F.window("at", "1 hour")
    out = R.run(_events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").cast("double").alias("start_s"), "event_type", "n", "total"), "update", ("start_s", "event_type"))
    return out


@query("WITH w AS (SELECT unnest([0, 1, 2]) AS k) SELECT (epoch_us(time_bucket(INTERVAL 10 minute, ts)) / 1000000 - k * 600)::DOUBLE AS start_s, count(*) AS n, max(value) AS peak FROM events, w GROUP BY ALL")
def stream_sliding(spark, d):
    """Windows of 30 minutes every 10 minutes."""
    w = F.window("at", "30 minutes", "10 minutes")
    return R.run(_events(spark, d).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(F.unix_timestamp("w.start").cast("double").alias("start_s"), "n", "peak"), "update", ("start_s",))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 hour, true) AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, epoch_us(min(ts)) / 1000000 AS start_s, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark, d):
    w = F.session_window("at", "4 hours")
    return R.run(_events(spark, d).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", (F.unix_micros("w.start") / 1e6).alias("start_s"), "n"), "complete")


@query("SELECT DISTINCT user_id, event_type, day(ts)::INT AS day FROM events")
def stream_dedup(spark, d):
    """One row for each user, type and day. The day's start is in the key, so that its state goes once the watermark has passed it."""
    rows = _events(spark, d).select("user_id", "event_type", F.window("at", "1 day").alias("w")).dropDuplicates(["user_id", "event_type", "w"])
    return R.run(rows.select("user_id", "event_type", F.dayofmonth("w.start").alias("day")), "append").distinct()


@query("SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 hour")
def stream_interval_join(spark, d):
    views = _events(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("at").alias("seen"))
    buys = _events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("at").alias("bought"))
    joined = views.join(buys, F.expr("user_id = buyer AND bought >= seen AND bought <= seen + INTERVAL 6 hours"))
    return R.run(joined.select("view_id", "purchase_id"), "append")


@query()
def stream_drift_detector(spark, d):
    """The stateful detector over each user's values; tests hold it against the batch form."""
    rows = _events(spark, d).select("user_id", "event_id", "at", "value")
    found = rows.groupBy("user_id").transformWithStateInPandas(R.DriftProcessor(0.9), R.DRIFT_ROWS, "append", "None")
    return R.run(found, "append")


@query()
def drift_detector_batch(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "value")
    return R.drift_batch(rows, 0.9)


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events WHERE day(ts) <= 15 GROUP BY ALL), p AS (SELECT e.event_id, e.user_id, e.event_type, 1 / (1 + exp(-(value - m) / sd)) AS p FROM events e JOIN s USING (event_type) WHERE day(ts) > 15)
SELECT event_id, user_id, event_type, round(p, 6) AS probability, 60.0::DOUBLE AS horizon_seconds FROM p WHERE p >= 0.8""")
def stream_alerts(spark, d):
    """Alerts from a stream scored against a model fitted on the first half: a probability from the threshold on, with a horizon of two steps of 30 s."""
    fit = table(spark, d, "events").where("dayofmonth(ts) <= 15").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    p = 1 / (1 + F.exp(-(F.col("value") - F.col("m")) / F.col("sd")))
    scored = _events(spark, d).where("dayofmonth(at) > 15").join(F.broadcast(fit), "event_type").withColumn("p", p).where("p >= 0.8D")
    return R.run(scored.select("event_id", "user_id", "event_type", F.round("p", 6).alias("probability"), F.lit(2 * 30.0).alias("horizon_seconds")), "append")
