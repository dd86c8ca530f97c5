"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

Method: four patterns give the base spans. Beside them a conditional random field labels words as names, numbers of
persons, or contacts, from features of their shape (kinds of characters, first and last kind, length, digits) and of cue
words and shapes around them. It is trained here from the small labelled table below by maximum likelihood. Viterbi decoding
runs in numpy over batches of word sequences. A word whose score for "outside" beats every other label by more than any
change of its two transitions could gain is outside in every best path; sequences are cut at such words, which leaves the
result of decoding the whole line as it is.

Cases: a null text is empty and has no spans; texts and lines of any length are decoded whole; repeated rows give repeated
results; an empty table gives no rows; other columns are not read. A span of the field that meets a base span is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, table, text_buffers, whole_text
from vigil.llm.wordhash import boundaries, hash_words

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", "name", "number", "contact")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TEN = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the whole run of local characters before it (after the last match) and a domain behind it."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = max(last, at)  # a later local part cannot hold this @
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches that pass, by kind and then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    if _TEN.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the labelled table: words of a sentence, each labelled word followed by /N (name), /D (number) or /C (contact)

TRAINING = """
my name is John/N Smith/N and I live here.
My name is Mary/N Jones./N
her name is Ana/N Lopez,/N she said.
his name is Pierre/N Martin/N today
Please ask Mr. Brown/N about the report.
Please ask Mrs. Green/N about it.
Dear Ms. White,/N thank you for the letter.
Dear Dr. Hans/N Müller,/N we met at the fair.
Contact Mr. David/N Clark/N for the keys.
Yours sincerely, Mr. Paul/N Weber/N
I spoke with Dr. Keller/N last week.
Name: Laura/N Rossi/N
Name: Peter/N Novak/N room 12
Patient name: Carla/N Mendes/N was seen on Monday.
her social security number is 123-45-6789/D today.
SSN: 987-65-4321/D
SSN 111-22-3333/D was given.
My passport number is X1234567/D and it is valid.
passport: AB987654/D issued in Rome.
account number 0012345678/D at the bank
Account: 99887766554/D please.
my card number is 4000123412341234/D and it expires soon
card: 5100-1234-1234-1234/D
Card number 4111222233334444/D was used.
id number 77889900/D on the form
tax id: 12345678901/D
Call me at 555-123-4567/C tonight.
call 555-9876/C now
phone: 020-7946-0018/C
Phone (212)/C 555-0100/C for help.
my phone is 0151-2345678/C in the evening
tel. 030-123456/C or write
Tel: 01.23.45.67.89/C
Fax: 555-222-1111/C
mobile 0612345678/C please
write to jane.doe@mail.example.org/C soon
Email: bob_77@host.example.com/C
email me at info@shop.example.net,/C thanks
mail to a.b@c.example/C today
The house stood on the hill and the river was below it.
It was the best of times. The people came from far away.
Is the weather good? The rain fell in the town for days.
And the old man said nothing. He went to the sea.
We sold 25 apples and 300 pears in 2019 for 4,500 euros.
In 1999 the price was 12.50 and in 2004 it was 99.
The version 2.0 of the work is out, see section 3.1 for more.
Licensed under the Apache License, Version 2.0.
This work is licensed under the GNU General Public License, version 3.
See chapter 12, page 345 and table 7.
Der Hund lief in den Wald. Die Kinder sahen ihn nicht.
Les enfants jouaient dans le jardin. Elle est partie hier.
El perro corre por la calle. Los niños juegan en la plaza.
THE END OF THE STORY IS NEAR AND THE SHIP SAILS.
WE! SAW! IT! ALL!! AND THEN!! IT STOPPED.
a value = "0a1b2c3d4e5f" in the code and x1 + y2 = z3
the file is at path/to/file_01.txt and the key is k-9.
Number one is the first. The number of cars was 250000 last year.
Of the ten, six are here | and four are there | so it is.
The account was closed. My card was lost. The phone rang twice.
the name of the rose is a book and the name is known.
Call the office at once. Write to the board. Email is down.
the total was 1234567 units on the night of the 14th.
Item 4 costs 7,99 and item 5 costs 100000 in all.
Then 10.20.30.40 was the address and 9999999999 the count.
"""

_MARK = {"N": 1, "D": 2, "C": 3}
#: Cue words (fixed values) and their classes.
CUES = {
    "name": 1, "named": 1, "mr": 2, "mrs": 2, "ms": 2, "dr": 2, "dear": 2, "ssn": 3, "passport": 3, "account": 3, "card": 3, "id": 3, "number": 3, "security": 3, "tax": 3,
    "call": 4, "phone": 4, "tel": 4, "fax": 4, "mobile": 4, "email": 5, "mail": 5, "write": 5, "is": 6, "at": 7, "to": 7, "me": 7,
}
N_CUES = 8

# kinds of bytes, as bits: lower-case letters and all of longer characters, upper case, digits, and signs
_LOWER, _UPPER, _DIGIT, _DOT, _AT, _DASH, _OTHER = (1 << k for k in range(7))
KIND = np.full(256, _OTHER, np.uint8)
KIND[128:] = _LOWER
KIND[ord("a") : ord("z") + 1] = _LOWER
KIND[ord("A") : ord("Z") + 1] = _UPPER
KIND[ord("0") : ord("9") + 1] = _DIGIT
KIND[[ord(c) for c in ".,;:!?"]] = _DOT
KIND[ord("@")] = _AT
KIND[[ord(c) for c in "-()/"]] = _DASH
_BIT = np.zeros(256, np.int64)
for _k in range(7):
    _BIT[1 << _k] = _k


@cache
def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the cue words in their usual writings, sorted, and their classes."""
    found: dict[str, int] = {}
    for word, kind in CUES.items():
        for form in (word, word.capitalize(), word.upper()):
            for end in ("", ":", ".", ","):
                found[form + end] = kind
    data = "".join(found).encode()
    ends = np.cumsum([len(w) for w in found])
    hashes = hash_words(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(hashes)
    return hashes[order], np.array(list(found.values()))[order]


def _cues(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Class of cue of the words at the indices `need`; 0 elsewhere."""
    out = np.zeros(len(starts), np.int64)
    need = need[(ends[need] - starts[need]) <= 10]
    if len(need):
        keys, kinds = _cue_table()
        found = hash_words(data, starts[need], ends[need])
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        out[need] = np.where(keys[at] == found, kinds[at], 0)
    return out


_SIZES = (128, 7, 7, 8, 6, 2 * 128, N_CUES * 2, N_CUES * 2, 128, N_CUES)
FEATURES = int(sum(_SIZES))
_AT = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word its feature numbers (one of each family), and whether it is plain: lower-case letters and closing signs, or the same with a capital first letter right after nothing that is a cue."""
    n = len(starts)
    kinds = KIND[data]
    # of a word only its own bytes count: white space between words is masked out
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    kinds = np.where(np.cumsum(inside[:-1]) > 0, kinds, 0).astype(np.uint8)
    bits = np.bitwise_or.reduceat(kinds, starts).astype(np.int64)
    first, last = _BIT[kinds[starts]], _BIT[kinds[ends - 1]]
    size = np.minimum(ends - starts, 15) // 2
    has_digit = np.flatnonzero(bits & _DIGIT)
    digits = np.zeros(n, np.int64)
    if len(has_digit):
        counts = np.concatenate([[0], np.cumsum(kinds == _DIGIT)])
        digits[has_digit] = np.minimum((counts[ends[has_digit]] - counts[starts[has_digit]] + 2) // 3, 5)
    odd = (bits & ~(_LOWER | _DOT)) != 0
    near = odd.copy()
    near[:-1] |= odd[1:]
    near[:-2] |= odd[2:]
    cue = _cues(data, starts, ends, np.flatnonzero(near))

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        """The value of the word `by` places before, 0 across a line's start."""
        out = np.zeros_like(values)
        out[by:] = values[:-by]
        for k in range(by):
            at = line_first + k
            out[at[at < n]] = 0
        return out

    before, before2 = shifted(cue, 1), shifted(cue, 2)
    after = np.zeros_like(bits)
    after[:-1] = bits[1:]
    ends_line = line_first[line_first > 0] - 1
    after[ends_line] = 0
    opens = np.zeros(n, np.int64)
    opens[line_first[line_first < n]] = 1
    after_stop = np.zeros(n, bool)
    after_stop[1:] = last[:-1] == _BIT[_DOT]
    opens |= (after_stop & (before != 2)).astype(np.int64)
    o = odd.astype(np.int64)
    families = (bits, first, last, size, digits, opens * 128 + bits, before * 2 + o, before2 * 2 + o, np.where(o, after, 0), cue * o)
    out = np.stack([f + a for f, a in zip(families, _AT, strict=True)], axis=1)
    return out.astype(np.int32), ~odd


class Field:
    """A linear-chain conditional random field with one weight for each feature and label."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        gain = move[:, :, None] + move[None, :, :]  # before, at, after
        # the most that a word can gain over "outside" from its transitions: inside a sequence, at its end, at its start
        self.bound = float(max((gain - gain[:, :1, :]).max(), (move - move[:, :1]).max(), (move - move[:1, :]).max()))

    @staticmethod
    def scores(features: np.ndarray, emit: np.ndarray) -> np.ndarray:
        out = emit[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += emit[features[:, k]]
        return out

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of the best path of each sequence; first: where each begins."""
        n = len(features)
        labels = np.zeros(n, np.int8)
        if not n:
            return labels
        score = self.scores(features, self.emit)
        fixed = score[:, 0] - score[:, 1:].max(axis=1) > self.bound
        free = np.flatnonzero(~fixed)
        if not len(free):
            return labels
        # pieces: runs of free words of one sequence, with the fixed words on both sides (outside in any best path)
        line = np.searchsorted(first, free, side="right")
        cut = np.flatnonzero((np.diff(free) > 1) | (np.diff(line) > 0)) + 1
        begin, end = free[np.concatenate([[0], cut])], free[np.concatenate([cut - 1, [len(free) - 1]])] + 1
        row = np.searchsorted(first, begin, side="right") - 1
        start_of, end_of = first[row], np.append(first, n)[row + 1]
        order = np.argsort(end - begin, kind="stable")
        for at in range(0, len(order), 4096):
            self._viterbi(score, begin, end, begin > start_of, end < end_of, order[at : at + 4096], labels)
        return labels

    def _viterbi(self, score, begin, end, bound_before, bound_after, rows, labels) -> None:
        size = (end - begin)[rows]
        most, k = int(size.max()), self.emit.shape[1]
        here = score[begin[rows]] + np.where(bound_before[rows, None], self.move[0][None, :], 0.0)
        back = np.zeros((most, len(rows), k), np.int8)
        final = here.copy()
        for t in range(1, most):
            live = size > t
            step = here[:, :, None] + self.move[None]
            back[t] = step.argmax(axis=1)
            here = step.max(axis=1) + score[np.minimum(begin[rows] + t, len(score) - 1)]
            final[live] = here[live]
        final = final + np.where(bound_after[rows, None], self.move[:, 0][None, :], 0.0)
        now = final.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            live = size > t
            labels[begin[rows][live] + t] = now[live]
            if t:
                now = np.where(live, back[t][np.arange(len(rows)), now], now)


def table_rows() -> list[tuple[list[str], list[int]]]:
    """The labelled table as words and labels."""
    out = []
    for line in TRAINING.strip().splitlines():
        words, labels = [], []
        for w in line.split(" "):
            m = re.fullmatch(r"(.*)/([NDC])", w)
            words.append(m[1] if m else w)
            labels.append(_MARK[m[2]] if m else 0)
        out.append((words, labels))
    return out


def train(rows: list[tuple[list[str], list[int]]] | None = None, rounds: int = 300, penalty: float = 0.02) -> Field:
    """Penalised maximum likelihood by full-batch gradient ascent with adaptive steps."""
    rows = rows or table_rows()
    data = np.frombuffer("\n".join(" ".join(w) for w, _ in rows).encode(), np.uint8)
    starts, ends, _ = boundaries(data, np.array([0, len(data)]))
    counts = np.array([len(w) for w, _ in rows])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    features, _ = shapes(data, starts, ends, first)
    gold = np.concatenate([y for _, y in rows])
    k, most, m = len(LABELS), int(counts.max()), len(rows)
    place = first[:, None] + np.minimum(np.arange(most)[None], counts[:, None] - 1)
    live = np.arange(most)[None] < counts[:, None]
    seen_emit, seen_move = np.zeros((FEATURES, k)), np.zeros((k, k))
    for f in range(features.shape[1]):
        np.add.at(seen_emit, (features[:, f], gold), 1)
    inner = np.ones(len(gold) - 1, bool)
    inner[first[1:] - 1] = False
    np.add.at(seen_move, (gold[:-1][inner], gold[1:][inner]), 1)
    emit, move = np.zeros((FEATURES, k)), np.zeros((k, k))
    speed_e, speed_m = np.zeros_like(emit), np.zeros_like(move)
    for _ in range(rounds):
        score = Field.scores(features, emit)[place]
        ahead, behind = np.zeros((m, most, k)), np.zeros((m, most, k))
        ahead[:, 0] = score[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(live[:, t, None], np.logaddexp.reduce(ahead[:, t - 1, :, None] + move[None], axis=1) + score[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), 0.0)
        total = np.logaddexp.reduce(ahead[np.arange(m), counts - 1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None])[live]
        index = place[live]
        want_emit, want_move = np.zeros_like(emit), np.zeros_like(move)
        for f in range(features.shape[1]):
            np.add.at(want_emit, features[index, f], chance)
        for t in range(1, most):
            on = live[:, t]
            want_move += np.exp(ahead[on, t - 1, :, None] + move[None] + (score[on, t] + behind[on, t])[:, None, :] - total[on, None, None]).sum(axis=0)
        slope_e, slope_m = seen_emit - want_emit - penalty * emit, seen_move - want_move - penalty * move
        speed_e += slope_e**2
        speed_m += slope_m**2
        emit = emit + 0.5 * slope_e / np.sqrt(speed_e + 1e-9)
        move = move + 0.5 * slope_m / np.sqrt(speed_m + 1e-9)
    return Field(emit, move)


def field_spans(data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of the field in each text, in code points: runs of words with one label, without signs at their ends."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    starts, ends, first = boundaries(data, offsets)
    if not len(starts):
        return out
    line_ends = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(line_ends, starts)
    text = np.searchsorted(offsets, starts, side="right") - 1
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(line) > 0) | (np.diff(text) > 0)]))
    features, _ = shapes(data, starts, ends, begins)
    labels = field.decode(features, begins)
    marked = np.flatnonzero(labels)
    if not len(marked):
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    head = np.zeros(len(starts), bool)
    head[begins] = True
    runs: list[list[int]] = []
    for i in marked.tolist():
        if runs and runs[-1][1] == i - 1 and labels[i] == labels[i - 1] and not head[i]:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    for lo, hi in runs:
        a, b = int(starts[lo]), int(ends[hi])
        while a < b and KIND[data[a]] in (_DOT, _OTHER):
            a += 1
        while b > a and KIND[data[b - 1]] in (_DOT, _OTHER):
            b -= 1
        if a < b:
            t = int(text[lo])
            zero = points[offsets[t]]
            out[t].append((LABELS[labels[lo]], int(points[a] - zero), int(points[b] - zero)))
    return out


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, stop in code points) for each row of docs."""
    field = field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            column = part.column(1)
            base = [base_spans(t or "") for t in column.to_pylist()]
            added = []
            for own, more in zip(base, field_spans(*text_buffers(column), field), strict=True):
                taken = sorted((s, e) for _, s, e in own)
                starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
                added.append([m for m in more if not _meets(starts, reach, m[1], m[2])])
            rows = [[{"kind": k, "start": s, "stop": e} for k, s, e in x] for x in base], [[{"kind": k, "start": s, "stop": e} for k, s, e in x] for x in added]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(r, SPAN) for r in rows)], ["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def _meets(starts: list[int], reach: list[int], start: int, stop: int) -> bool:
    """Whether one of some spans, given by their sorted starts and how far those up to each reach, meets start..stop."""
    at = bisect_left(starts, stop)
    return at > 0 and reach[at - 1] > start


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
