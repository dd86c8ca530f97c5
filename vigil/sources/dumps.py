"""Readers of raw dumps: metric ranges, traces and logs as JSON, feature stores as npz, tables as CSV.

Schemas are given, never inferred. Malformed entries are passed over; numbers that cannot be read are null.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vigil.functions.aggregates import safe_float

_SERIES = "struct<data:struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>>"
_TRACES = "traces array<struct<traceID:string,processes:map<string,struct<serviceName:string>>,spans:array<struct<traceID:string,spanID:string,processID:string,startTime:bigint,duration:bigint,references:array<struct<refType:string,spanID:string>>,tags:array<struct<key:string,value:string>>>>>>"
_LOGS = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"


def metric_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A map of query to range result: query, labels, ts, value."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.explode(F.from_json("value", f"map<string,{_SERIES}>")).alias("query", "r"))
    series = found.select("query", F.explode("r.data.result").alias("s")).select("query", F.col("s.metric").alias("labels"), F.explode("s.values").alias("v"))
    return series.where(F.size("v") >= 2).select("query", "labels", safe_float(F.get("v", F.lit(0))).alias("ts"), safe_float(F.get("v", F.lit(1))).alias("value"))


def traces(spark: SparkSession, path: str, dedup: bool = True) -> DataFrame:
    """Spans with seconds, the first CHILD_OF parent, the service of the process, status and retry; the first of equal (trace_id, span_id)."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", _TRACES).alias("d")).select(F.posexplode("d.traces").alias("ti", "t"))
    rows = rows.select("ti", "t.processes", "t.traceID", F.posexplode("t.spans").alias("si", "s"))
    parents = F.filter("s.references", lambda r: r["refType"] == "CHILD_OF")

    def tagged(keys: list[str], values: list[str]):
        return F.coalesce(F.exists("s.tags", lambda t: t["key"].isin(keys) & F.lower(t["value"]).isin(values)), F.lit(False))

    out = rows.select(
        "ti", "si",
        F.coalesce("s.traceID", "traceID").alias("trace_id"),
        F.col("s.spanID").alias("span_id"),
        F.coalesce(F.get(parents, F.lit(0))["spanID"], F.lit("")).alias("parent_span_id"),
        F.coalesce(F.try_element_at("processes", F.col("s.processID"))["serviceName"], F.lit("")).alias("service_name"),
        (F.col("s.duration") / 1e6).alias("duration_s"),
        (F.col("s.startTime") / 1e6).alias("start_time_s"),
        F.when(tagged(["error"], ["true"]) | tagged(["otel.status_code"], ["error"]), "ERROR").otherwise("OK").alias("status_code"),
        tagged(["retry", "is_retry"], ["true"]).alias("is_retry"),
    )
    if dedup:
        order = W.partitionBy("trace_id", "span_id").orderBy("ti", "si")
        out = out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return out.drop("ti", "si")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with seconds, service, pod and body."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", _LOGS)["streams"]).alias("s")).select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    label = F.coalesce(*[F.nullif(F.try_element_at("labels", F.lit(k)), F.lit("")) for k in ("service_name", "service", "app", "container")], F.lit(""))
    rows = rows.where(F.size("v") >= 2).select((F.get("v", F.lit(0)).try_cast("bigint") / 1e9).alias("ts_s"), label.alias("service_name"), F.coalesce(F.try_element_at("labels", F.lit("pod")), F.lit("")).alias("pod_name"), F.get("v", F.lit(1)).alias("body"), F.coalesce(F.try_element_at("labels", F.lit("level")), F.lit("")).alias("level"))
    return rows.where("ts_s IS NOT NULL")


def signals(spark: SparkSession, path: str, key: str = "signal") -> DataFrame:
    """Arrays (t, service, feature) of npz files as long rows: file, t, service, feature, value, missing as null."""

    def run(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as store:
                    x = store[key].astype(float)
                t, n, f = np.indices(x.shape).reshape(3, -1)
                yield pd.DataFrame({"file": name, "t": t, "service": n, "feature": f, "value": x.ravel()})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, t int, service int, feature int, value double")
    return rows.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table; without rows where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
        return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.createDataFrame([], T._parse_datatype_string(schema))
