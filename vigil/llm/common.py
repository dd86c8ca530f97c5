"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and 0x09-0x0D, as a regular-expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows of a narrow table that one file takes.
FILE_ROWS = 100_000

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, even where body uses it inside a lambda function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where the session has none a temporary one of this process on one machine, and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="vigil-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return _OWN_DIRS[app]


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vigil/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again. It cuts the lineage; the files outlive any executor.

    rows: about how many there are at most, for narrow tables whose last stage is light. Then there are no more files than they
    need, however many partitions a shuffle has: for each file and folder on a disk of its own an executor starts processes
    (chmod for the file, its checksum and its folder), and each file is a scan's overhead later.
    """
    spark = df.sparkSession
    path = path or new_dir(spark, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with those of df, compared without case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (or the bytes of binary values), one after another, and the offsets of the texts; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return bytes_, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each (a longer text has a slice of its own), so that memory follows the longest text rather than rows times length."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def python_chunks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """As chunks(), with the texts as Python strings."""
    for part in chunks(batches, "text", most):
        column = part.column(part.schema.get_field_index("text"))
        yield part, [t or "" for t in column.to_pylist()]


def returned(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow or mapInPandas; after a partition the worker gives free memory back to the system, since Spark keeps workers for later tasks and allocators keep what a task freed."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return tidy
