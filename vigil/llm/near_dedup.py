"""Near-duplicate classes by BagMinHash on the multisets of word shingles.

Two documents are linked when the weighted Jaccard similarity of their multisets of SHINGLE consecutive words is THRESHOLD or
more; classes are the connected components of the links.

Method:
1. Documents with the same multiset are one node.
2. Each node has a BagMinHash signature of BANDS x DEPTH registers; nodes that agree on a band share a bucket. At a similarity
   of 0.8 a pair shares none with a probability of 5e-5.
3. In each bucket the members are compared with the smallest one, which joins most of what belongs together. Comparisons are
   exact, on the texts, and each pair is compared once.
4. A bucket whose members still lie in several components is dealt into blocks of BLOCK members (or BLOCK_BYTES of text), each
   member in one block, and the components of a block are linked: a member and one of another component are compared exactly
   when their signatures are not five standard deviations below the threshold, the most similar first, until the components
   are one. Members of one component need no comparison, since they cannot change a class. A bucket of one block is done then;
   the others are dealt once more by another hash.
5. In buckets of several blocks that still hold several components, each member outside the bucket's largest component meets
   every block of the bucket in the same way. So each pair of components is compared in full, no pair and no component
   becomes a row, and neither a bucket nor a component meets in one task. What is left for this step are the few members that
   resemble hardly any of a thousand others of their bucket.

Two chances to miss a link remain, both set by the parameters: no band shared (5e-5 at 0.8), and a signature five standard
deviations off (3e-7).

Cases: a text of fewer than SHINGLE words has one shingle, all of it; a null text or one without words is a class of its own
and not copied by any other; repeated rows are members of one class; a null doc_id counts as larger than all others; an empty
table gives no rows; other columns are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.bagminhash import signatures, similarity
from vigil.llm.common import chunks, free_name, materialize, returned, table, text_buffers, whole_text
from vigil.llm.components import components
from vigil.llm.substring_dedup import LAST, keyed
from vigil.llm.wordhash import boundaries, hash_runs, hash_words, mix, run_starts

SHINGLE, THRESHOLD, BANDS, DEPTH = 5, 0.8, 25, 5
BLOCK, BLOCK_BYTES = 1024, 32 << 20


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of every shingle, as often as it occurs."""
    data, offsets = text_buffers(column)
    starts, ends, first = boundaries(data, offsets)
    words = hash_words(data, starts, ends)
    at, text = run_starts(first, size)
    owner, element = [text], [hash_runs(words, size)[at]]
    counts = np.diff(first)
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            owner.append(rows)
            element.append(hash_runs(words, short, seed=short)[first[:-1][rows]])
    return np.concatenate(owner), np.concatenate(element)


def profile(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """Per row: n shingles, k1 and k2 (the multiset's hash), the bands' hashes and the registers' low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 3 << 20):
            owner, element = shingles(part.column(3), size)
            order = np.lexsort((element, owner))
            owner, element = owner[order], element[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])])) if len(owner) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(owner)))
            rows = part.num_rows
            n = np.bincount(owner, minlength=rows)
            keys = []
            for seed in (31, 32):
                total = np.zeros(rows, np.uint64)
                if len(owner):
                    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    total[owner[begins]] = np.add.reduceat(mix(element, seed), begins)
                keys.append(total.view(np.int64))
            points = signatures(owner[first], element[first], count, rows, bands * depth)
            hashes = np.empty((rows, bands), np.uint64)
            for b in range(bands):
                value = np.full(rows, np.uint64(b))
                for k in range(depth):
                    value = mix(value * np.uint64(0x9FB21C651E98DF25) ^ points[:, b * depth + k], 33)
                hashes[:, b] = value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * bands, pa.int32()), pa.array(hashes.ravel().view(np.int64)))
            low = (points >> np.uint64(8)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), lists, pa.array([r.tobytes() for r in low], pa.binary())],
                ["doc_id", "place", "th", "n", "k1", "k2", "bands", "sig"],
            )

    found = keyed(docs).mapInArrow(returned(run), "doc_id long, place long, th long, n long, k1 long, k2 long, bands array<long>, sig binary")
    return found.withColumn("uid", F.monotonically_increasing_id())


def compare(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """pairs (a, b of nodes) with their exact similarity. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in chunks(iter([whole]), "text", 2 << 20):
                found = similarity(*shingles(part.column(2), size), *shingles(part.column(3), size), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], ["a", "b", "j"])

    left = pairs.join(texts.select(F.col("node").alias("a"), "text"), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")
    return both.mapInArrow(returned(run), "a long, b long, j double")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups: what one batch leaves open waits for the next."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]) if rest is not None else now
        last = np.ones(rest.num_rows, bool)
        for k in keys:
            last &= rest.column(k).to_numpy() == rest.column(k)[-1].as_py()
        cut = int(np.argmax(last))
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None:
        yield rest


def _cuts(table_: pa.Table, keys: tuple[str, ...]) -> list[tuple[int, int]]:
    new = np.zeros(max(table_.num_rows - 1, 0), bool)
    for k in keys:
        new |= np.diff(table_.column(k).to_numpy()) != 0
    at = (np.flatnonzero(new) + 1).tolist()
    return list(zip([0, *at], [*at, table_.num_rows], strict=True))


def _signatures(column: pa.ChunkedArray, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), registers)


def _least(threshold: float, registers: int) -> float:
    """The share of equal registers that a pair at the threshold does not fall short of: five standard deviations below."""
    return threshold - 5 * (threshold * (1 - threshold) / registers) ** 0.5


def _counted(owner: np.ndarray, element: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different elements of each of n multisets with their counts, where each multiset starts, and the sizes."""
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return element[new], np.diff(np.append(new, len(owner))), np.searchsorted(owner[new], np.arange(n + 1)), np.bincount(owner, minlength=n)


def _join(group: pa.Table, lo: int, hi: int, least: float, threshold: float, size: int) -> list[tuple[int, int]]:
    """Links that make one of the components of rows lo..hi that have one. A guest meets every host, and two that are both meet once."""
    part = group.slice(lo, hi - lo)
    node, guest, sig = part.column("node").to_numpy(), part.column("guest").to_numpy(), _signatures(part.column("sig"), len(part.column("sig")[0].as_py()))
    up = np.unique(part.column("comp").to_numpy(), return_inverse=True)[1].astype(np.int64)  # the component that each row is in by now
    guests, hosts = np.flatnonzero(guest > 0), np.flatnonzero(guest != 1)
    if not len(guests) or not len(hosts) or up.min() == up.max():
        return []
    element, count, start, total = _counted(*shingles(part.column("text").combine_chunks(), size), hi - lo)
    out = []
    for a in guests.tolist():
        some = hosts if guest[a] == 1 else hosts[hosts > a]
        some = some[up[some] != up[a]]
        if not len(some):
            continue
        near = (sig[some] == sig[a]).mean(axis=1)
        pick = some[near >= least][np.argsort(-near[near >= least], kind="stable")]
        own, times = element[start[a] : start[a + 1]], count[start[a] : start[a + 1]]
        while len(pick):
            now, pick = pick[:128], pick[128:]
            sizes = start[now + 1] - start[now]
            index = np.repeat(start[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            place = np.minimum(np.searchsorted(own, element[index]), len(own) - 1)
            common = np.where(own[place] == element[index], np.minimum(times[place], count[index]), 0)
            shared = np.bincount(np.repeat(np.arange(len(now)), sizes), common, minlength=len(now))
            for b in now[shared / np.maximum(total[a] + total[now] - shared, 1) >= threshold].tolist():
                if up[a] != up[b]:
                    out.append((int(node[a]), int(node[b])))
                    up[up == up[b]] = up[a]
            pick = pick[up[pick] != up[a]]
    return out


def _links(rows: DataFrame, threshold: float, registers: int, size: int) -> DataFrame:
    """rows: bucket, part, guest (0 a host, 1 a guest, 2 both), node, comp, sig, text. Returns links a, b that join components within the parts."""
    keys, least = ("bucket", "part"), _least(threshold, registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            out = [link for lo, hi in _cuts(group, keys) if hi - lo > 1 for link in _join(group, lo, hi, least, threshold, size)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "guest", "node", "comp", "sig", "text").mapInArrow(returned(run), "a long, b long")


def _blocks(rows: str, volume: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(volume) / BLOCK_BYTES)).cast("int")


def _dealt(salt: int, n: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")


def _rest(members: DataFrame, links: DataFrame, nodes: DataFrame, threshold: float, registers: int, size: int) -> tuple[DataFrame, DataFrame]:
    """members: bucket, node, of buckets with more than two. nodes: node, sig, text, volume. Returns all links, and the components by them: node, root."""

    def named(roots: DataFrame) -> DataFrame:
        return members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))

    def apart(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return materialize(several.select("bucket"), "several", rows=most)

    def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = materialize(_links(rows.join(nodes.select("node", "sig", "text"), "node"), threshold, registers, size), "more-links")
        if not (added := more.count()):
            return links, roots
        n = links.count() + added
        both = materialize(links.union(more), "all-links", rows=n)
        return both, materialize(components(both, n), "roots", rows=2 * n)

    most, n = members.count(), links.count()
    roots = materialize(components(links, n), "roots", rows=2 * n)
    for salt in (9, 10):
        rows = named(roots)
        several = apart(rows)
        if not several.limit(1).count():
            return links, roots
        open_rows = materialize(rows.join(several, "bucket", "left_semi").join(nodes.select("node", "volume"), "node"), "open", rows=most)
        sizes = materialize(open_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume")).select("bucket", _blocks("rows", "volume").alias("n")).where("n > 1" if salt > 9 else "n > 0"), "sizes", rows=most)
        if salt > 9 and not sizes.limit(1).count():
            return links, roots
        links, roots = linked(open_rows.select("bucket", "node", "comp").join(sizes, "bucket").select("bucket", _dealt(salt, F.col("n")).alias("part"), F.lit(2).alias("guest"), "node", "comp"))
        if salt == 9:
            members = materialize(open_rows.select("bucket", "node").join(sizes.where("n > 1").select("bucket"), "bucket", "left_semi"), "wide", rows=most)
    rows = named(roots)
    several = apart(rows)
    if not several.limit(1).count():
        return links, roots
    open_rows = materialize(rows.join(several, "bucket", "left_semi").join(nodes.select("node", "volume"), "node"), "open", rows=most)
    counts = open_rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))
    counts = counts.groupBy("bucket").agg(F.max(F.struct("rows", "comp", "volume")).alias("most"), F.sum("rows").alias("rows"), F.sum("volume").alias("volume"))
    counts = counts.withColumns({"others": F.col("rows") - F.col("most.rows"), "other_volume": F.col("volume") - F.col("most.volume")})
    sizes = materialize(counts.select("bucket", F.col("most.comp").alias("main"), _blocks("rows", "volume").alias("n"), _blocks("others", "other_volume").alias("t")), "sizes", rows=most)
    both = open_rows.join(sizes, "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    hosts = both.select("*", every("t")).select("bucket", (_dealt(11, F.col("n")) * F.col("t") + F.col("other")).alias("part"), F.lit(0).alias("guest"), "node", "comp")
    guests = both.where("comp <> main").select("*", every("n")).select("bucket", (F.col("other") * F.col("t") + _dealt(12, F.col("t"))).alias("part"), F.lit(1).alias("guest"), "node", "comp")
    links, roots = linked(hosts.unionByName(guests))
    return links, roots


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: doc_id, place, th, uid, root (the class's number), kept (true for the smallest doc_id of the class), class_id (that doc_id) and class_size."""
    rows = materialize(profile(docs, size, bands, depth), "profile")
    n = rows.count()
    first = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("uid").alias("node"))
    heads = rows.join(first, ["k1", "k2", "n"]).where("uid = node")
    spread = heads.select("node", F.explode("bands").alias("bucket"))
    # written, so that the join has plain exchanges on both sides, whose large partitions Spark can split
    sizes = materialize(spread.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1"), "sizes", rows=n * bands // 2)
    members = materialize(spread.join(sizes, "bucket").select("bucket", "node", "head", "k"), "members", rows=n * bands)
    wanted = members.select("node").distinct()
    named = heads.select("node", "place", "th", "sig").join(wanted, "node")
    named = materialize(named.dropDuplicates(["place", "th"]), "named", rows=n)
    texts = keyed(docs).dropDuplicates(["place", "th"]).join(named, ["place", "th"]).select("node", "sig", "text", F.octet_length("text").cast("long").alias("volume"))
    texts = materialize(texts, "texts")

    roots = members.select("node", F.col("node").alias("root")).limit(0)
    if members.limit(1).count():
        todo = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
        links = materialize(compare(todo, texts, size).where(F.col("j") >= threshold).select("a", "b"), "links")
        _, roots = _rest(members.where("k > 2").select("bucket", "node"), links, texts, threshold, bands * depth, size)
    placed = rows.select("doc_id", "place", "th", "uid", "n", "k1", "k2").join(first, ["k1", "k2", "n"], "left").join(roots, "node", "left")
    placed = placed.select("doc_id", "place", "th", "uid", F.coalesce("root", "node", "uid").alias("root"))
    best = materialize(placed.groupBy("root").agg(F.min(F.struct("place", "uid", "doc_id")).alias("best"), F.count(F.lit(1)).alias("class_size")), "classes", rows=n)
    return placed.join(best, "root").select("doc_id", "place", "th", "uid", "root", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("best.doc_id").alias("class_id"), "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of docs."""
    place, th = free_name(docs, "place"), free_name(docs, "th")
    kept = materialize(classes(docs).where("kept").select(F.col("place").alias(place), F.col("th").alias(th)), "kept", rows=docs.count())
    found = docs.withColumns({place: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), th: F.xxhash64(whole_text())}).join(kept, [place, th], "left_semi")
    if kept.count() < found.count():  # rows alike in doc_id and text
        found = found.dropDuplicates([place, th])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")
