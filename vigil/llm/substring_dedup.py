"""Removal of passages that an earlier document has: exact, with a count-min prefilter.

Words are maximal runs of characters other than space and 0x09-0x0D; a window is `size` consecutive words of a document. A
word goes when a window over it also starts in a document with a smaller doc_id.

Method:
1. Documents with the same words as one of a smaller doc_id are settled at once: all of their windows repeat.
2. Every window has an anchor, the least hash of the runs of ANCHOR words in it; equal windows have equal anchors, so the
   number of documents with an anchor is never below that of any window of it. Each partition counts its documents' anchors
   into the cells of a count-min sketch of ROWS rows, and the partitions' cells are merged by Spark's sums. A row has LOAD to
   2 * LOAD cells for each anchor that was counted, so cells are shared, estimates are too high now and then (`over_count`
   measures how often), and the sketch, a table spread over the cluster, is bounded by its width whatever the texts hold.
3. Only windows whose anchor has two documents or more by every row of the sketch are hashed (128 bits) and grouped by that,
   with the smallest doc_id; those that repeat are joined back and their words removed. The estimate is never too low, so no
   window is lost.
A hot anchor or window is summed in each partition before the shuffle, and the join back is one that Spark can split.

Cases: a null text has no words; texts shorter than a window lose nothing; windows repeated inside one document alone stay;
rows with the same doc_id count as one document; a null doc_id counts as larger than all others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, materialize, table, text_buffers, whole_text
from vigil.llm.wordhash import boundaries, hash_runs, hash_words, run_starts

SIZE, ANCHOR, ROWS, LOAD = 50, 16, 2, 4
#: The place of a null doc_id.
LAST = (1 << 63) - 1


def anchors(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each run of `size` words the least hash of the shorter runs in it."""
    short = min(ANCHOR, size)
    low = hash_runs(words, short, seed=3)
    count = size - short + 1
    out_n = len(words) - size + 1
    if out_n <= 0:
        return np.zeros(0, np.uint64)
    span = 1
    while 2 * span <= count:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:out_n], low[count - span : count - span + out_n])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the document's place in the order, a hash of the text that tells rows of one doc_id apart, and the text."""
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"), F.xxhash64(text).alias("th"), text.alias("text"))


def profile(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: n_words, sha256 of the words joined by a space, and the different anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, offsets = text_buffers(part.column(3))
            starts, ends, first = boundaries(data, offsets)
            words = hash_words(data, starts, ends)
            at, text = run_starts(first, size)
            found = anchors(words, size)[at]
            new = np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])]) if len(found) else np.zeros(0, bool)
            found, text = found[new], text[new]
            order = np.lexsort((found, text))
            found, text = found[order], text[order]
            new = np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])]) if len(found) else np.zeros(0, bool)
            found, text = found[new], text[new]
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            raw = data.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(first), pa.int64()), pa.array(shas, pa.binary()), lists], ["doc_id", "place", "th", "n_words", "sha", "anchors"])

    return keyed(docs).mapInArrow(run, "doc_id long, place long, th long, n_words long, sha binary, anchors array<long>")


def width_for(anchors: int) -> int:
    """Cells of a row of the sketch: the first power of two from LOAD a counted anchor on."""
    return 1 << max(10, (LOAD * max(anchors, 1) - 1).bit_length())


def cell(row: int, width: int) -> Column:
    """The cell of an anchor in a row of the sketch, the rows one after another."""
    return F.pmod(F.xxhash64(F.col("anchor"), F.lit(row)), F.lit(width)) + row * width


def sketch(found: DataFrame, width: int, rows: int = ROWS) -> DataFrame:
    """The merged count-min sketch: (cell, n) for the cells that two or more documents fall into. found: anchor, one row for each document and anchor."""
    return found.select(F.explode(F.array(*[cell(r, width) for r in range(rows)])).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def over_count(found: DataFrame, width: int) -> DataFrame:
    """One row: anchors (different ones), taken (those that the sketch takes as repeated) and repeated (those that are)."""
    counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    left, full = counts, sketch(found, width)
    for r in range(ROWS):
        left = left.withColumn("cell", cell(r, width)).join(full.select("cell"), "cell", "left_semi").drop("cell")
    return counts.agg(F.count(F.lit(1)).alias("anchors")).join(left.agg(F.count(F.lit(1)).alias("taken"), F.sum((F.col("n") > 1).cast("long")).alias("repeated")))


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Of rows (doc_id, place, th, text, anchors): the windows with one of the row's anchors, as indices, texts and two hashes."""
    for part in chunks(batches):
        data, offsets = text_buffers(part.column(3))
        starts, ends, first = boundaries(data, offsets)
        words = hash_words(data, starts, ends)
        at, text = run_starts(first, size)
        found = anchors(words, size)[at]
        lists = part.column(4)
        held = np.sort(_keys(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())))
        keys = _keys(found, text)
        live = held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys if len(held) else np.zeros(len(keys), bool)
        at, text = at[live], text[live]
        other = hash_words(data, starts, ends, seed=1)
        yield part, data, starts, ends, first, at, text, hash_runs(words, size)[at].view(np.int64), hash_runs(other, size, seed=1)[at].view(np.int64)


def _keys(anchor: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One key for an anchor and a text of the chunk. Two that fall together only let a window through."""
    return anchor ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _rows(*columns: np.ndarray) -> np.ndarray:
    """Rows of whole numbers as values that compare as one."""
    return np.ascontiguousarray(np.column_stack([c.astype(np.uint64) for c in columns])).view(np.dtype((np.void, 8 * len(columns)))).ravel()


def suspects(docs: DataFrame, rows: DataFrame, size: int = SIZE, width: int | None = None) -> DataFrame:
    """The rows of docs with windows that the sketch takes as repeated, with their anchors of that kind."""
    found = rows.where(F.size("anchors") > 0).select("place", "th", F.explode("anchors").alias("anchor"))
    if width is None:
        width = width_for(rows.agg(F.sum(F.size("anchors"))).first()[0] or 0)
    full = materialize(sketch(found.select("anchor"), width), "sketch")
    for r in range(ROWS):
        cells = full.where((F.col("cell") >= r * width) & (F.col("cell") < (r + 1) * width)).select("cell")
        found = found.withColumn("cell", cell(r, width)).join(cells, "cell", "left_semi").drop("cell")
    held = found.groupBy("place", "th").agg(F.collect_set("anchor").alias("anchors"))
    return keyed(docs).join(held, ["place", "th"]).select("doc_id", "place", "th", "text", "anchors")


def repeated(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(place, th, windows): the windows of each suspect row that also start in a document with a smaller place, as pairs of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_, text, one, two in _windows(batches, size):
            if not len(text):
                continue
            order = np.lexsort((two, one, text))
            text, one, two = text[order], one[order], two[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            text, one, two = text[new], one[new], two[new]
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), part.column(1).take(row), part.column(2).take(row)], ["w1", "w2", "place", "th"])

    seen = texts.mapInArrow(run, "w1 long, w2 long, place long, th long")
    least = seen.groupBy("w1", "w2").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most").select("w1", "w2", "least")
    return seen.join(least, ["w1", "w2"]).where("least < place").groupBy("place", "th").agg(F.collect_list(F.struct("w1", "w2")).alias("windows"))


def _cleaned(texts: DataFrame, windows: DataFrame, size: int = SIZE) -> DataFrame:
    """(place, th, n_removed, kept) for the suspect rows that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, starts, ends, first, at, text, one, two in _windows(batches, size):
            pairs = part.column(5)
            flat = pairs.flatten()
            w1, w2 = (flat.field(k).to_numpy().view(np.uint64) for k in (0, 1))
            owner = np.repeat(np.arange(part.num_rows), pairs.value_lengths().to_numpy())
            gone = _rows(owner, w1, w2)
            start = at[np.isin(_rows(text, one.view(np.uint64), two.view(np.uint64)), gone)]
            cover = np.bincount(start, minlength=len(starts) + 1) - np.bincount(start + size, minlength=len(starts) + 1)
            lost = np.cumsum(cover[:-1]) > 0
            raw, kept, n = data.tobytes(), [], []
            for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                stay = np.flatnonzero(~lost[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
                n.append(b - a - len(stay))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["place", "th", "n_removed", "kept"])

    given = texts.join(windows, ["place", "th"]).dropDuplicates(["place", "th"]).select("doc_id", "place", "th", "text", "anchors", "windows")
    return given.mapInArrow(run, "place long, th long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, size: int = SIZE, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables. First, one row for each row of docs: doc_id, place, th, n_words, sha, whole (true if all words go as a copy). Second, (place, th, n_removed, kept) for the others that lose words."""
    rows = materialize(profile(docs, size), "profile")
    long = rows.where(F.col("n_words") >= size)
    several = long.groupBy("sha", "n_words").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(several.select("sha", "n_words", "first"), "copies")  # so that Spark can split the join
    marked = materialize(
        rows.join(first, ["sha", "n_words"], "left").select("doc_id", "place", "th", "n_words", "sha", F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("whole"), "anchors"), "marked"
    )
    texts = materialize(suspects(docs, marked.where("NOT whole").dropDuplicates(["place", "th"]), size, width), "suspects")
    return marked.drop("anchors"), _cleaned(texts, repeated(texts, size), size)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cleaned = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cleaned = cleaned.select("place", "th", F.col("n_removed").alias("some"), F.sha2("kept", 256).alias("kept_sha"))
    found = rows.join(cleaned, ["place", "th"], "left")
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda k: sha256(array_to_string(ws[k:k + 49], ' ')))) AS h
  FROM w WHERE len(ws) >= 50
), c AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE least < doc_id
), p AS (
  SELECT w.doc_id, i, word FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w) w
), k AS (
  SELECT p.doc_id, p.i, word, coalesce(p.i - max(c.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) < 50, false) AS gone
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i
), t AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""
