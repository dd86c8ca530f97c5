"""Training order, written as fixed-stride shards of token ids.

Method: each partition of the documents is one stream of ids, its documents one after another, cut into sequences of `length`
ids; so only the last sequence of a partition is padded. A sequence's number is the count of those of the partitions before
it, plus its place; a keyed Feistel permutation of the least domain of 4^k that holds all numbers, walked along its cycle
until it falls below their count, gives its global slot. Shard k holds the slots from k * per_shard on, `stride` bytes each,
so a reader finds slot s at byte (s mod per_shard) * stride of its shard, reads on in order, and resumes anywhere.

Texts are encoded once: the ids are stored as Parquet, each row with its partition and its place in the stream, so what is
read back may be dealt in any way and executors may be lost. One row a partition (its ids) comes to the driver. What a batch
sends to one shard travels as one compressed row; ranges of neighbouring shards are the partitions that write them, each with
whole shards in order, one in memory at a time. The permutation spreads every document over all shards, so none is larger
than another. An attempt writes a shard under its own name in a folder of attempts and then renames it; the folder goes at
the end, and the manifest is written last, so a folder with a manifest is complete.

The query's ids are those of a public sentencepiece vocabulary, two bytes each (little-endian, as are the machines), the same as the library's.
Each distinct pre-token of a partition is encoded once. Without a vocabulary, write() takes the bytes of UTF-8 as ids.

Cases: a null or empty text has no ids and gives one row without a slot; very long texts lie in many sequences, and short ones
share one; repeated rows are documents of their own; an empty table gives no rows and no shard; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, materialize, new_dir, python_chunks, table, text_buffers, whole_text
from vigil.llm.token_counts import PieceCounter
from vigil.llm.wordhash import mix

LENGTH, PER_SHARD, KEY = 512, 16_384, 20_240_229
_ROUNDS = 6
ROWS = "doc_id long, seq long, slot long, shard long, offset long, n_ids long"
#: Tasks that write shards, at most; each has a range of them.
WRITERS = 20_000
#: Entries of a task's table of ids, about 120 bytes each.
CACHE_ENTRIES = 700_000


def feistel(numbers: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..size-1. The domain is under four times as large, so a walk takes under four steps on average."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(_ROUNDS, dtype=np.uint64) + np.uint64(key % (1 << 63)), seed=11)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys[::-1] if inverse else keys:
            left, right = (right ^ (mix(left ^ k) & mask), left) if inverse else (right, left ^ (mix(right ^ k) & mask))
        return (left << shift) | right

    out = once(np.asarray(numbers, np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _shard_name(root: str, shard: int) -> str:
    return f"{root}/{shard:010d}.bin"


class PieceIds(PieceCounter):
    """Ids of texts, put together from those of their pre-tokens."""

    def __init__(self, model: str, entries: int = CACHE_ENTRIES):
        super().__init__(model)
        self.entries = entries
        if self.pieces.get_piece_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit into two bytes")
        self.ids: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = set().union(*split) - self.ids.keys()
        if len(self.ids) + len(new) > self.entries:
            self.ids.clear()
            new = set().union(*split)
        words = list(new)
        self.ids.update(zip(words, (array("H", ids).tobytes() for ids in self.encode(words)), strict=True))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


def utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def encode(docs: DataFrame, coder: Callable[[], Callable[[list[str]], list[bytes]]], width: int) -> DataFrame:
    """doc_id, part (the number of the task), first (where the document's ids begin in the task's stream), n (how many) and ids. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, at = coder(), TaskContext.get().partitionId(), 0
        for rows, texts in python_chunks(batches, 8 << 20):
            ids = code(texts)
            n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "first", "n", "ids"])
            at = int(ends[-1])

    return docs.mapInArrow(run, "doc_id long, part long, first long, n long, ids binary")


def _pressed(codec: pa.Codec, data) -> bytes:
    """Compressed, behind the size that it had."""
    return len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True)


def _plain(codec: pa.Codec, data: bytes) -> pa.Buffer:
    return codec.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"))


def _pieces(rows: pa.RecordBatch, length: int, begins: dict[int, int], total: int, key: int) -> tuple[np.ndarray, ...]:
    """Of rows (doc_id, part, first, n, ids) the parts that lie in one sequence: row, number in the row, slot, place in the sequence, place in the row, ids."""
    part, first, n = (rows.column(k).to_numpy() for k in (1, 2, 3))
    low, high = first // length, (first + n - 1) // length
    count = np.where(n > 0, high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    seq = low[row] + k
    start, end = np.maximum(first[row], seq * length), np.minimum((first + n)[row], (seq + 1) * length)
    base = np.array([begins[p] for p in part.tolist()], np.int64)
    return row, k, feistel(base[row] + seq, total, key), start - seq * length, start - first[row], end - start


def write(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, model: str | None = None) -> DataFrame:
    """Write the shards, and last manifest.json, below path. Returns one row for each part of a document in one sequence: doc_id, seq (the part's number), the sequence's slot, shard, offset (the part's first byte in the shard) and n_ids. model: the vocabulary of the ids; without one they are bytes."""
    spark, width = docs.sparkSession, 2 if model else 1
    stride = length * width
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    coded = encode(texts, (lambda: PieceIds(model)) if model else lambda: utf8, width)
    stored = new_dir(spark, "ids")
    coded.write.option("compression", "zstd").parquet(stored)
    ids = spark.read.schema(coded.schema).parquet(stored)
    begins, total = {}, 0
    for r in sorted(ids.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):
        begins[r.part] = total
        total += -(-r.n // length)
    none = [F.lit(None).cast("long").alias(c) for c in ("seq", "slot", "shard", "offset")]
    empty = ids.where("n = 0").select("doc_id", *none, F.lit(0).cast("long").alias("n_ids"))
    if not total:
        return empty
    files, root = _file_system(path)
    files.create_dir(f"{root}/attempts", recursive=True)
    shards = -(-total // per_shard)
    span = -(-shards // WRITERS)  # shards of a writer

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for rows in chunks(batches, "ids", 8 << 20):
            row, k, slot, place, at, n = _pieces(rows, length, begins, total, key)
            data, offsets = text_buffers(rows.column(4))
            raw, doc = memoryview(data), rows.column(0)
            order = np.argsort(slot, kind="stable")
            low, size = (offsets[:-1][row] + at * width)[order], (n * width)[order]
            shard = slot[order] // per_shard
            cuts = (np.flatnonzero(np.diff(shard)) + 1).tolist()
            out: list[tuple[int, bytes, bytes]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(order)], strict=True):
                if lo == hi:
                    continue
                pick = order[lo:hi]
                about = pa.RecordBatch.from_arrays([doc.take(pa.array(row[pick])), *(pa.array(x[pick]) for x in (k, slot, place, n))], ["doc_id", "seq", "slot", "place", "n_ids"])
                body = b"".join([raw[a : a + b] for a, b in zip(low[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)])
                out.append((int(shard[lo]), _pressed(codec, about.serialize()), _pressed(codec, body)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "about", "body"])

    about_schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "seq", "slot", "place", "n_ids")])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of shards: fill one shard, and write it when the next begins."""
        files, root = _file_system(path)
        codec, now, full = pa.Codec("zstd"), -1, np.zeros(0, np.uint8)

        def close() -> None:
            if now >= 0:
                own = f"{root}/attempts/{uuid.uuid4().hex}"
                with files.open_output_stream(own) as f:
                    f.write(memoryview(full))
                files.move(own, _shard_name(root, now))

        for batch in batches:
            for shard, about, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    close()
                    now, full = shard, np.zeros(min(per_shard, total - shard * per_shard) * stride, np.uint8)
                rows = pa.ipc.read_record_batch(_plain(codec, about), about_schema)
                data = np.frombuffer(_plain(codec, body), np.uint8)
                slot, place, n = (rows.column(i).to_numpy() for i in (2, 3, 4))
                at, begin = (slot - shard * per_shard) * stride + place * width, 0
                for p, x in zip(at.tolist(), (n * width).tolist(), strict=True):
                    full[p : p + x] = data[begin : begin + x]
                    begin += x
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(np.full(len(at), shard)), pa.array(at), rows.column(4)], ["doc_id", "seq", "slot", "shard", "offset", "n_ids"])
        close()

    packed = ids.where("n > 0").mapInArrow(send, "shard long, about binary, body binary")
    ranges = packed.repartitionById(-(-shards // span), F.floor(F.col("shard") / span).cast("int")).sortWithinPartitions("shard")
    index = materialize(ranges.mapInArrow(store, ROWS), "index")
    files.delete_dir(f"{root}/attempts")
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"length": length, "stride": stride, "width": width, "per_shard": per_shard, "total": total, "key": key}).encode())
    return index.unionByName(empty)


def read(path: str, slot: int = 0, count: int | None = None) -> Iterator[tuple[int, bytes]]:
    """The sequences from a slot on, in training order, each with its full stride."""
    files, root = _file_system(path)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        spec = json.loads(f.read())
    upto = spec["total"] if count is None else min(spec["total"], slot + count)
    while slot < upto:
        shard, place = divmod(slot, spec["per_shard"])
        with files.open_input_file(_shard_name(root, shard)) as f:
            f.seek(place * spec["stride"])
            for _ in range(min(upto - slot, spec["per_shard"] - place)):
                yield slot, f.read(spec["stride"])
                slot += 1


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write(table(spark, sf_dir, "documents").select("doc_id", "text"), new_dir(spark, "shards"), model=str(public_tokenizers.path("piece_bpe_32k.model")))
