"""Tables that jobs hand on to one another, as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset: below a temporary one of this process on one machine, and an error on a cluster, whose executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="vigil-stored-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = _OWN[0]
    return f"{root.rstrip('/')}/vigil/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written and read again: the lineage ends, and losing an executor loses nothing."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
