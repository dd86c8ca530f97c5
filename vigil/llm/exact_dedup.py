"""Exact deduplication with disk-backed streaming state.

Method: every row becomes an *arrival* (digest, identifier, number of code points, normalised text), stored as Parquet; its
locator is the file and the row there. A Structured Streaming aggregation keeps, for each digest and without expiry, the
arrival that stays (identifier and locator) and the size of the group; its state lives in RocksDB, and Spark sums a
partition's rows before the shuffle, so that a hot digest costs one row a partition. Each micro-batch checks its hits (digests
seen more than once by then) on the full bytes: all arrivals with such a digest must have one text. Digests that fail the
check (a collision) are told apart by their whole text in a second run, so the result never rests on the digest alone.
Joins on the digest have plain exchanges on both sides, so Spark can split a hot one.

Cases: a null text is empty; empty texts (and those of white space alone) are equal to each other; ties go to the
smallest doc_id (nulls last), then to the least locator, so repeated rows leave exactly one; an empty table
gives no rows; other columns are ignored or carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vigil.llm.common import SPACE_CLASS, materialize, new_dir, whole_text

#: State on disk; without room set aside in advance, of which each of many small stores would take megabytes.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without space and 0x09-0x0D."""
    return F.regexp_replace(text, f"{SPACE_CLASS}+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256, apart: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """One row a document: doc_id, n_points, digest and norm (the normalised text), or with payload in place of that the row itself.

    apart: digests whose groups hold different texts; for these the key is the digest and the whole text.
    """
    text = whole_text()
    norm = normalised(text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select("doc_id", F.length(text).alias("n_points"), digest(norm).alias("digest"), norm.alias("norm"), *([row.alias("row")] if payload else []))
    if apart is not None:
        found = found.join(apart.select("digest", F.lit(True).alias("differs")), "digest", "left").withColumn(
            "digest", F.when(F.col("differs"), F.concat("digest", F.encode("norm", "UTF-8"))).otherwise(F.col("digest"))
        )
    return found.select("doc_id", "n_points", "digest", "row" if payload else "norm")


def located(stored: DataFrame) -> DataFrame:
    """Stored arrivals with their locators: the file and the row in it."""
    return stored.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))


def keep_state(stream: DataFrame) -> DataFrame:
    """Per digest: the arrival that stays (most code points, then smallest doc_id, then least locator) and the number of arrivals."""
    best = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("at").alias("keep_at"))
    return stream.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))


def differing(stored: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests among hits that more than one text has, by comparing the full bytes of all stored arrivals with them."""
    norm = F.col("norm") if "norm" in stored.columns else normalised(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    texts = stored.select("digest", norm.alias("norm")).join(hits, "digest", "left_semi")
    return texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest")


def start_stream(stored: str, schema: StructType, out: str, checkpoint: str, spark: SparkSession, **trigger) -> StreamingQuery:
    """Deduplicate the arrivals that are stored below a folder, and those yet to come there, for as long as it runs.

    Each micro-batch writes the digests that it changed to state/batch=N below out, and those of its hits whose texts differ to
    differing/batch=N, so a batch that is run again replaces its files. The state and the offsets are in checkpoint: a restart
    goes on from there. The check of a batch reads the stored arrivals once.
    """
    stream = located(spark.readStream.schema(schema).parquet(stored)).select("doc_id", "n_points", "digest", "at")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/state/batch={number}")
        hits = own.read.parquet(f"{out}/state/batch={number}").where("group_size > 1").select("digest")
        differing(own.read.schema(schema).parquet(stored), hits).write.mode("overwrite").parquet(f"{out}/differing/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        return keep_state(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, out: str) -> DataFrame:
    """The state of each digest after the last batch: both parts of it only ever move one way."""
    schema = "digest binary, best struct<less int, no_id boolean, keep_id bigint, keep_at struct<file string, row bigint>>, group_size bigint, batch int"
    found = spark.read.schema(schema).option("basePath", f"{out}/state").parquet(f"{out}/state")
    return found.groupBy("digest").agg(F.min("best").alias("best"), F.max("group_size").alias("group_size"))


def _run(docs: DataFrame, digest: Callable[[Column], Column], apart: DataFrame | None, payload: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored arrivals, the state, and the digests that differ."""
    spark = docs.sparkSession
    path, out = new_dir(spark, "arrivals"), new_dir(spark, "state")
    stored = materialize(arrivals(docs, digest, apart, payload), "arrivals", path)
    none = stored.select("digest").limit(0)
    if not (n := stored.count()):
        return located(stored), keep_state(located(stored).select("doc_id", "n_points", "digest", "at")), none
    start_stream(path, stored.schema, out, new_dir(spark, "stream"), spark, availableNow=True).awaitTermination()
    return located(stored), materialize(state_table(spark, out), "kept", rows=n), spark.read.schema(none.schema).parquet(f"{out}/differing").distinct()


def classes(docs: DataFrame, digest: Callable[[Column], Column] = sha256, payload: bool = False) -> DataFrame:
    """One row a document: doc_id, at (its locator), digest, keep_id, keep_at, group_size (and row)."""
    seen, state, apart = _run(docs, digest, None, payload)
    if apart.limit(1).count():
        seen, state, _ = _run(docs, digest, apart, payload)
    return seen.join(state, "digest").select("doc_id", "at", "digest", "best.keep_id", "best.keep_at", "group_size", *(["row"] if payload else []))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    found = classes(docs, payload=True)
    return found.where("at = keep_at").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""
