"""Writers: Parquet stores, JSON lines, N-Triples, and an append-only record of finished work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(df: DataFrame, path: str, keys: tuple[str, ...] = ("episode_id",)) -> None:
    """Parquet by partition columns; only the partitions of df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """Arrays and structs as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def n_triples(triples: DataFrame, path: str, base: str) -> None:
    """Triples (s, p, o, o_num) as N-Triples lines."""

    def iri(c):
        return F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_"), F.lit(">"))

    number = F.concat(F.lit('"'), F.col("o_num").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double>'))
    line = F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("o").isNotNull(), iri(F.col("o"))).otherwise(number), F.lit("."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no record of being finished."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
