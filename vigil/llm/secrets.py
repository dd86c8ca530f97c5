"""Secrets: three exact patterns, and character Markov models of random strings against ordinary ones.

Method, in DataFrame and SQL functions only. The patterns give the base spans; a text is split at a pattern's matches, and
running sums of the lengths of the pieces and of the matches give the places. Beside them, each run of 20 or more characters
of `[A-Za-z0-9+/_=-]` is scored by the log-likelihood ratio of two first-order Markov models, per transition. Both are trained
from labelled samples: random strings (made from hashes of a counter, in hexadecimal, base 64 and letters with digits) and
ordinary ones (words of eight or more letters, and identifiers joined from such words). The samples are bounded by two
parameters: SAMPLE strings of either label, the ordinary ones from TEXTS different texts, those with the smallest hashes. A
run counts as a secret when the ratio per transition is above THRESHOLD and no base span meets it.

A text costs time in proportion to its length and its matches (but for sorting them): sums run in blocks, a run's characters
are folded one after another, and whether a run meets a base span is told by counts of starts and stops.

Cases: a null text is empty and has no spans; very long texts are read whole; repeated rows give repeated results; an empty
table gives no rows (the ordinary model then holds its prior alone); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import let, table, whole_text

#: Strings of either label to train from, texts that the ordinary ones come from, characters of a run that is scored, and the ratio per transition.
SAMPLE, TEXTS, RUN, THRESHOLD = 20_000, 1_000, 20, 0.6
#: Values whose sums are run at once, and pairs of a run and a base span that are compared one by one.
BLOCK, PAIRS = 256, 4096

# The patterns are fixed values. Letters of the key words are in either case, in ASCII alone.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
KINDS = ("assign", "access", "hex", "random")


_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,body:string>>"


def running(values: Column) -> Column:
    """The sums of an array of int up to each place. Sums run inside blocks of BLOCK and then over the blocks, since adding to an array copies it."""
    none = F.array().cast("array<int>")

    def sums(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    def joined_up(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, k: let(F.coalesce(F.get(e, k - 1), F.lit(0)), lambda low: F.transform(b, lambda x: x + low)))))

    def cut(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: sums(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(v) == 0, none).when(F.size(v) <= BLOCK, sums(v)).otherwise(let(blocks, joined_up))

    return let(values, cut)


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """The matches of a pattern as an array of (start, rank, stop, kind, body), in code points; body is the group's text.

    The pieces between matches come from split(), which is as long as the matches and one more. The pattern must not match
    the empty string.
    """

    def found(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        stops = running(F.zip_with(gaps, whole, lambda gap, m: F.length(gap) + F.length(m)))
        body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

        def made(at: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                stop = F.get(at["stops"], i)
                return F.struct((stop - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), F.get(at["body"], i).alias("body"))

            return F.transform(whole, one)

        return let(F.struct(stops.alias("stops"), body.alias("body")), made)

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(F.array().cast(_SPANS))


def random_strings(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """Labelled random strings: hexadecimal, base 64, and base 64 without signs."""
    ids = spark.range(n)
    hexed = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    based = F.base64(F.unhex(hexed))
    return ids.select(F.when(F.col("id") % 3 == 0, F.substring(hexed, 1, 40)).when(F.col("id") % 3 == 1, based).otherwise(F.regexp_replace(based, "[+/=]", "")).alias("s"))


def ordinary_strings(docs: DataFrame, n: int = SAMPLE, texts: int = TEXTS) -> DataFrame:
    """Labelled ordinary strings: the n words of eight or more letters with the smallest hashes in the `texts` different texts with the smallest hashes, alone and joined as identifiers are. Only hashes are ordered; copies of a text count once."""
    hashed = docs.select(whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    picked = hashed.select("h").distinct().orderBy("h").limit(texts)
    sample = hashed.join(F.broadcast(picked), "h").dropDuplicates(["h"])
    words = sample.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)))).alias("w")).distinct()
    words = words.orderBy(F.xxhash64("w"), "w").limit(n)
    low, kind = F.lower("w"), F.abs(F.xxhash64("w", F.lit(1))) % 4
    half = F.lit(4)
    return words.select(
        F.when(kind == 0, F.col("w"))
        .when(kind == 1, F.concat_ws("_", F.substring(low, 1, 4), low.substr(F.lit(5), F.length("w"))))
        .when(kind == 2, F.concat(F.substring(low, 1, 4), F.initcap(low.substr(half + 1, F.length("w")))))
        .otherwise(F.concat_ws("-", low, (F.abs(F.xxhash64("w", F.lit(2))) % 30).cast("string")))
        .alias("s")
    )


def transitions(strings: DataFrame) -> DataFrame:
    """How often each character follows another: at most 67 x 67 rows, the pattern's characters squared."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.col("s").substr(i, F.lit(2)))
    found = strings.where(F.length("s") >= 2).select(F.explode(pairs).alias("pair")).where(F.rlike("pair", F.lit("^[A-Za-z0-9+/_=-]{2}$")))
    return found.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(docs: DataFrame) -> list[float]:
    """For each pair of ASCII characters, at 128 * first + second: the log of its chance in random strings over that in ordinary ones, each count being larger by 0.5 than it is."""
    from math import log

    spark = docs.sparkSession
    counts = []
    for strings in (random_strings(spark), ordinary_strings(docs)):
        rows = transitions(strings).collect()
        counts.append({r.pair: r.n for r in rows})
    out = [0.0] * (128 * 128)
    letters = [chr(c) for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]
    for a in letters:
        totals = [sum(c.get(a + b, 0) for b in letters) for c in counts]
        for b in letters:
            chance = [(c.get(a + b, 0) + 0.5) / (t + 0.5 * len(letters)) for c, t in zip(counts, totals, strict=True)]
            out[128 * ord(a) + ord(b)] = log(chance[0] / chance[1])
    return out


def ratio(body: Column, ratios: Column) -> Column:
    """The mean log ratio of a string's transitions; the characters are folded from the left."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        gain = F.when(acc["last"] < 0, 0.0).otherwise(F.get(ratios, acc["last"] * 128 + F.ascii(c)))
        return F.struct(F.ascii(c).alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(body, ""), zero, step, lambda acc: acc["sum"]) / (F.length(body) - 1)


def apart(runs: Column, base: Column) -> Column:
    """The runs, in order and without overlaps, that no base span meets: those before whose end as many base spans start as stop before them."""

    def counted(points: Column, asked: Column, asked_first: bool) -> Column:
        """For each asked place the number of points below it (and on it, unless it is asked first)."""
        marks = F.concat(
            F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(int(asked_first)).alias("order"), F.lit(1).alias("n"))),
            F.transform(asked, lambda p: F.struct(p.alias("at"), F.lit(int(not asked_first)).alias("order"), F.lit(0).alias("n"))),
        )
        return let(F.array_sort(marks), lambda m: F.transform(F.filter(F.zip_with(m, running(m["n"]), lambda x, s: F.struct(x["n"].alias("n"), s.alias("s"))), lambda x: x["n"] == 0), lambda x: x["s"]))

    def many(r: Column) -> Column:
        starts, stops = counted(base["start"], r["stop"], True), counted(base["stop"], r["start"], False)
        met = F.zip_with(starts, stops, lambda a, b: a - b)
        return F.transform(F.filter(F.zip_with(r, met, lambda x, n: F.struct(x.alias("run"), n.alias("n"))), lambda x: x["n"] == 0), lambda x: x["run"])

    def few(r: Column) -> Column:
        return F.filter(r, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))

    return let(runs, lambda r: F.when((F.size(r) == 0) | (F.size(base) == 0), r).when(F.size(r).cast("long") * F.size(base) <= PAIRS, few(r)).otherwise(many(r)))


def find(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added for each row of docs: arrays of (start, rank, stop, kind, body), base in order of start and kind."""
    ratios = ratios or log_ratios(docs)
    lookup = F.split(F.lit(",".join(f"{r:.6g}" for r in ratios)), ",").cast("array<double>")
    text = whole_text()
    assign = F.filter(spans(F.col("text"), ASSIGN, "assign", 2), lambda s: F.length(s["body"]) >= 8)
    base = F.array_sort(F.concat(assign, spans(F.col("text"), ACCESS, "access"), spans(F.col("text"), HEX, "hex")))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base.alias("base"))
    runs = F.filter(spans(F.col("text"), CANDIDATE, "random"), lambda s: ratio(s["body"], lookup) > threshold)
    return found.select("doc_id", "base", apart(runs, F.col("base")).alias("added"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[n(k) for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
