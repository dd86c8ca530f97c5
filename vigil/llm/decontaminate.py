"""Benchmark decontamination by templates, in DataFrame and SQL functions only.

Method: texts are brought to a template: words that begin with a digit become a number placeholder, capitalised words inside a
sentence a name placeholder, and units behind a number a unit placeholder; other words lose case and signs. Windows of SIZE
template words of the documents are hash-joined with those of the benchmark that hold LITERAL literal words or more. Aligned
windows of a document and an item (equal differences of places) are taken together, and their slots checked: each original
word of the item must stand for one word of the document throughout, so a question with other numbers is found, and chance
alignments of placeholders are not. A document is contaminated by an item when RUN aligned windows agree (all of the item's,
if it has fewer).

The benchmark's windows are broadcast only up to BROADCAST windows; beyond that the join is a shuffled one. Items with one
text count as the smallest item_id of them. Items of fewer than SIZE words have no window and match nothing.

Cases: null texts are empty; texts of any length are read whole, the placeholders' own characters counting as signs; rows with the same doc_id and text are one document; an
empty table, of documents or of the benchmark, gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import SPACE_CLASS, free_name, let, materialize, table, whole_text

SIZE, LITERAL, RUN, BROADCAST = 8, 5, 3, 200_000
#: The windows that keep one mapping of the slots must be so large a part (two thirds) of the aligned ones.
SHARE = 2, 3
#: Literal words of a window in which every capitalised word is a name.
WIDE_LITERAL = 4
#: Control characters that mark a word from the front: placeholders of both templates, then of the wide template alone (a unit, a capitalised word).
NUMBER, NAME, UNIT, WIDE_UNIT, WIDE_NAME = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Marked words sort below it, others do not, since signs drop out.
UNMARKED = "\x06"
#: Units that count as such behind a number.
UNITS = "mm cm dm m km g mg kg t l ml s ms min h hours hour minutes minute seconds second days day weeks week months month years year miles mile feet foot inches inch pounds pound euros euro dollars dollar percent degrees degree meters meter metres metre grams gram liters liter".split()

_NOT_SPACE = r"[^\x20\x09-\x0D]"


def any_of(text: Column, *parts: str) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def marked(text: Column) -> Column:
    """The text with marks before words: those that begin with a digit, capitalised ones behind a space that a lower-case letter, comma or semicolon (no number's) precedes, and units behind a number and white space (tokens() tells those behind a space from others)."""
    own = NUMBER + NAME + UNIT + WIDE_UNIT + WIDE_NAME
    text = F.when(any_of(text, *own), F.translate(text, own, "-" * len(own))).otherwise(text)
    numbered = F.regexp_replace(text, rf"(?<!{_NOT_SPACE})[^\p{{L}}\p{{N}}\x20\x09-\x0D]*[0-9]", f"{NUMBER}$0")
    named = F.regexp_replace(numbered, r"\p{Lu}(?<=[\p{Ll},;]{1,3}\x20\p{Lu})", f"{NAME}$0")  # Java counts what it looks back at in 16-bit units; {1,3} leaves room for two a character
    named = F.regexp_replace(named, rf"({NUMBER}{_NOT_SPACE}*\x20){NAME}", "$1")
    unit = rf"({NUMBER}{_NOT_SPACE}*{SPACE_CLASS}+)((?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
    return F.regexp_replace(named, unit, f"$1{UNIT}$2")


def tokens(marked: Column) -> Column:
    """The words of a marked text in lower case and without signs, behind their marks. Words without a letter or digit have dropped out."""
    both = F.when(any_of(marked, *(c + UNIT for c in "\t\n\x0b\x0c\r")), F.regexp_replace(marked, rf"([\x09-\x0D]){UNIT}", f"$1{WIDE_UNIT}")).otherwise(marked)
    bare = F.regexp_replace(both, rf"[^\p{{L}}\p{{N}}{NUMBER}-{WIDE_UNIT}\x20\x09-\x0D]+", "")
    lower = F.lower(F.regexp_replace(bare, rf"\p{{Lu}}(?<!{_NOT_SPACE}{{1,2}}\p{{Lu}})", f"{WIDE_NAME}$0"))
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", lower)
    return F.array_remove(F.split(spaced, " "), "")


def folded(token: Column) -> Column:
    """The word without its mark."""
    return F.when(token < UNMARKED, F.substr(token, F.lit(2))).otherwise(token)


def word_hash(token: Column, form: str) -> Column:
    """A hash of the word in a form: fold (as it is), words (the template's: placeholders for numbers, names and units), wide (the template in which capitalised words are names wherever they stand, so a sentence's first word is one too)."""
    bare, mark = F.xxhash64(F.substr(token, F.lit(2))), F.xxhash64(F.substr(token, F.lit(1), F.lit(1)))
    rest = {
        "fold": bare,
        "words": F.when(token < WIDE_UNIT, mark).otherwise(bare),
        "wide": F.when(token < WIDE_UNIT, mark).when(token < WIDE_NAME, F.xxhash64(F.lit(UNIT))).otherwise(F.xxhash64(F.lit(NAME))),
    }
    return F.when(token >= UNMARKED, F.xxhash64(token)).otherwise(rest[form])


def windows(rows: DataFrame, size: int) -> DataFrame:
    """rows (with `tokens`) once for each window: at (from 0). The size is tested in the generator: as a filter it would move below the template and compute that again."""
    at = F.explode(F.when(F.size("tokens") >= size, F.sequence(F.lit(0), F.size("tokens") - size))).alias("at")
    return rows.select("*", at)


def window_hash(hashed: str, size: int) -> Column:
    return F.xxhash64(*[F.get(hashed, F.col("at") + k) for k in range(size)])


def forms(rows: DataFrame, *kept: str) -> DataFrame:
    """rows (text) with its tokens, and for each form a hash of each word, so that a window's is one of numbers and no words are copied."""
    made = rows.select(*kept, marked(F.col("text")).alias("marked")).select(*kept, tokens(F.col("marked")).alias("tokens"))
    return made.withColumns({f"{k}_h": F.transform("tokens", lambda w: word_hash(w, k)) for k in ("words", "wide", "fold")})  # noqa: B023


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, literal: int = LITERAL) -> DataFrame:
    """hash, item_id, item_at, exact (the window's folded words, without slots), n_item (windows of the item), n_slot (those with a template), slots (folded words and places of the window's placeholders)."""
    text = whole_text()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id"))
    found = windows(forms(items, "item_id"), size)
    kinds = [F.struct(window_hash("fold_h", size).alias("hash"), F.lit(True).alias("exact"), F.lit(None).cast("array<struct<i:int,word:string>>").alias("slots"))]
    fits = {}
    for words, least, bound in (("words", literal, WIDE_UNIT), ("wide", min(literal, WIDE_LITERAL), UNMARKED)):
        places = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("tokens", F.col("at") + i) < bound)  # noqa: B023
        slots = F.transform(places, lambda i: F.struct(i.alias("i"), folded(F.get("tokens", F.col("at") + i)).alias("word")))
        fits[words] = F.size(places) <= size - least
        kinds.append(F.when(fits[words] & (F.size(places) > 0), F.struct(window_hash(f"{words}_h", size).alias("hash"), F.lit(False).alias("exact"), slots.alias("slots"))))
    found = found.withColumn("usable", fits["words"] | fits["wide"]).withColumn("kinds", F.array_distinct(F.array_compact(F.array(*kinds))))
    sizes = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.sum(fits["words"].cast("long")).alias("n_slot"))
    found = found.select("item_id", F.col("at").alias("item_at"), "usable", F.explode("kinds").alias("kind"))
    return found.select("kind.*", "item_id", "item_at", "usable").join(sizes, "item_id")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, run: int = RUN, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_windows (aligned and consistent), n_item, reworded (some slot differs)."""
    sides = materialize(benchmark_windows(benchmark, size), "benchmark")
    known = sides.select("hash", "item_id", "item_at", "exact", "usable", "n_item", "n_slot", "slots")
    if known.count() <= broadcast:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    hashes = [window_hash(f"{k}_h", size).alias(k) for k in ("words", "wide", "fold")]  # columns: a generator would work each out again wherever it names it
    one, two, three = (F.col(k) for k in ("words", "wide", "fold"))
    found = F.array(one, F.when(two != one, two), F.when((three != one) & (three != two), three))  # a null joins nothing
    hit = windows(forms(rows, "doc_id", "th"), size).select("doc_id", "th", "tokens", "at", *hashes).select("doc_id", "th", "tokens", "at", F.explode(found).alias("hash")).join(known, "hash")
    pairs = F.transform(F.coalesce("slots", F.array().cast("array<struct<i:int,word:string>>")), lambda s: F.struct(s["word"].alias("item"), folded(F.get("tokens", F.col("at") + s["i"])).alias("doc")))
    hit = hit.select("doc_id", "th", "item_id", "n_item", "n_slot", (F.col("at") - F.col("item_at")).alias("shift"), F.struct("at", "exact", "usable", pairs.alias("pairs")).alias("hit"))
    aligned = hit.groupBy("doc_id", "th", "item_id", "n_item", "n_slot", "shift").agg(F.collect_set("hit").alias("hits"))
    aligned = aligned.withColumn("every", F.flatten("hits.pairs"))
    aligned = aligned.withColumn("seen", F.transform(F.array_distinct("every"), lambda p: F.struct(p.alias("pair"), F.size(F.filter("every", lambda q: q == p)).alias("n"))))
    beaten = lambda c: F.exists("seen", lambda e: (e["pair"]["item"] == c["pair"]["item"]) & ((e["n"] > c["n"]) | (e["n"] == c["n"]) & (e["pair"]["doc"] < c["pair"]["doc"])))
    lost = F.transform(F.filter("seen", beaten), lambda c: c["pair"])
    aligned = aligned.withColumn("good", let(lost, lambda pairs: F.filter("hits", lambda h: ~F.arrays_overlap(h["pairs"], pairs))))
    places = lambda name, test: F.size(F.array_distinct(F.transform(F.filter(name, test), lambda h: h["at"])))
    n, whole = places("good", lambda h: F.lit(True)), F.least(F.lit(run), F.col("n_item"))
    most = SHARE[1] * n >= SHARE[0] * places("hits", lambda h: F.lit(True))
    short = (F.col("n_slot") > 0) & (places("good", lambda h: h["usable"]) >= F.least(F.lit(run), F.col("n_slot")))
    aligned = aligned.where((places("hits", lambda h: h["exact"]) >= whole) | most & ((n >= whole) | short))
    differs = F.exists("every", lambda p: p["item"] != p["doc"])
    return aligned.select("doc_id", "th", "item_id", "n_item", n.alias("n"), differs.alias("differs")).groupBy("doc_id", "th", "item_id", "n_item").agg(F.max("n").alias("n_windows"), F.max("differs").alias("reworded"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with the columns of docs."""
    bad_id, bad_th = free_name(docs, "bad_id"), free_name(docs, "bad_th")
    bad = materialize(matches(docs, benchmark).select(F.col("doc_id").alias(bad_id), F.col("th").alias(bad_th)).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(whole_text()) == F.col(bad_th)), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"), F.max("n_item").alias("n_item"), F.max("reworded").alias("reworded"))
