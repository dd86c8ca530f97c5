"""Token counts without token ids.

Method: a text is cut into pre-tokens that no piece of the vocabulary can cross.
1. Each partition sums how many of its documents hold each pre-token; merged, that is the table of distinct pre-tokens.
2. The pieces of each distinct pre-token are counted once, in the partitions of that table, which is written.
3. Documents are read again as pre-token frequencies and joined to the counts. The pre-tokens that most documents hold, HOT at
   most, are broadcast, so a word that a third of all documents hold is joined and summed where it is. The other frequencies,
   if there are any, go through a shuffled join with the whole table and are summed by document.
No ids are made, and nothing is kept between the batches of a partition but the broadcast table.

Cases: a null text is empty and has no tokens; very long texts are counted whole; repeated rows give repeated results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialize, python_chunks

#: Pre-tokens of a partition that are summed before they go on, and those whose counts are broadcast, about 100 bytes each.
FLUSH, HOT = 400_000, 1_000_000
#: A line end is in no piece (it is one byte token), and a piece has the space mark only at its start.
_PARTS = re.compile(r"\n| *[^ \n]+| +")


class PieceCounter:
    """Counts of a sentencepiece BPE vocabulary whose space mark never follows another character inside a piece."""

    def __init__(self, model: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        own = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in own):
            raise ValueError("pieces of this vocabulary cross pre-tokens")
        self.before = len(self.pieces.encode("\n"))
        self.mark = self.pieces.encode("\n")[:1]

    @staticmethod
    def split(text: str) -> list[str]:
        return _PARTS.findall(" " + text.replace("▁", " ")) if text else []

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token. The library puts a space mark before what it encodes: it stands for the first space of the pre-token; before one that has none, a line end keeps the mark apart."""
        found = self.pieces.encode([w[1:] if w[0] == " " else "\n" + w for w in words], num_threads=1)
        return [(ids or self.mark) if w[0] == " " else ids[self.before :] for w, ids in zip(words, found, strict=True)]


def vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """word, docs (documents that hold it), pieces: one row for each distinct pre-token. docs: text."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "docs"])
            seen.clear()
            return made

        for _, texts in python_chunks(batches, 2 << 20):
            for text in texts:
                seen.update(set(PieceCounter.split(text)))
            if len(seen) > FLUSH:
                yield out()
        if seen:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, counter.encode(part.column(0).to_pylist())), pa.int64())], ["word", "docs", "pieces"])

    distinct = docs.select("text").mapInArrow(words, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return distinct.mapInArrow(pieces, "word string, docs long, pieces long")


def _least(known: DataFrame, hot: int) -> tuple[int, bool]:
    """The number of documents from which on at most `hot` words are held, and whether these are all words. One row for each eighth of a power of two of documents comes to the driver."""
    step = F.floor(F.log2("docs") * 8)
    n, least = 0, 1 << 62
    for r in known.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).orderBy(F.col("step").desc()).collect():
        n += r.n
        if n > hot:
            return least, False
        least = r.least
    return least, True


def token_counts(docs: DataFrame, model: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs. hot: pre-tokens whose counts are broadcast at most."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialize(vocabulary(texts, model), "pieces")
    least, every = _least(known, hot)
    shared = spark.sparkContext.broadcast(known.where(F.col("docs") >= least).select("word", "pieces").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict(zip(*(c.to_pylist() for c in shared.value.columns), strict=True))
        for part, rows in python_chunks(batches, 2 << 20):
            sizes, sums, words, times, ends = [], [], [], [], [0]
            for text in rows:
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                frequencies = Counter(PieceCounter.split(text))
                if every:
                    sums.append(sum(map(mul, frequencies.values(), map(counts.__getitem__, frequencies))))
                else:
                    sums.append(sum(n * counts[w] for w, n in frequencies.items() if w in counts))
                    rest = [(w, n) for w, n in frequencies.items() if w not in counts]
                    words += [w for w, _ in rest]
                    times += [n for _, n in rest]
                ends.append(len(words))
            ends_ = pa.array(ends, pa.int32())
            arrays = [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(ends_, pa.array(words, pa.string())), pa.ListArray.from_arrays(ends_, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_bytes", "n", "words", "times"])

    found = texts.mapInArrow(run, "doc_id long, n_bytes long, n long, words array<string>, times array<long>")
    if every:
        return found.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    found = materialize(found.withColumn("uid", F.monotonically_increasing_id()), "frequencies")
    cold = found.where(F.size("words") > 0).select("uid", F.explode(F.arrays_zip("words", "times")).alias("f")).select("uid", F.col("f.words").alias("word"), F.col("f.times").alias("times"))
    more = cold.join(known.select("word", "pieces"), "word").groupBy("uid").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return found.join(more, "uid", "left").select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).withColumn("over_limit", F.col("n_tokens") > limit)
