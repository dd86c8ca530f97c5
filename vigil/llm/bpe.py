"""Byte-pair encoding and decoding by an index of pair occurrences.

Method: texts are split at white space; words with characters beyond ASCII are normalised and cut by the tokenizer file's own
normaliser and pre-tokeniser, so that every code point is read as the library reads it, and ASCII words by the same rules
here. The distinct words of a chunk of a partition are laid out as one array of symbols. An index maps each pair that
has a rank to all its positions in the chunk. Active ranks are taken in ascending order from a heap: all occurrences of
the pair are merged at once, and the lists of the pairs that this makes are updated (positions that no longer hold their
pair are passed over when their turn comes). Words are numbered, and a word's ids and decoded tokens are kept for later
chunks of the partition in a table of bounded size, from which a text's are taken by its words' numbers. Nothing is shuffled.

Cases: a null text is empty and has no tokens; special strings inside a text are their own tokens, as the library's
default has it; very long texts and words are encoded whole; repeated rows give repeated results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import python_chunks, returned

#: Words in the table of a partition beyond which it is thinned out, about 200 bytes each.
CACHE_WORDS = 150_000
#: Words beyond ASCII that one call of the library cuts.
TOGETHER = 256
#: Unicode's White_Space, which str.split() exceeds by U+001C-U+001F.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES, _ODD = re.compile(f"[{_SPACE}]+"), re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is a visible Latin-1 character, else the next free one from U+0100."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class PairIndex:
    """Merges with ranks, applied to many words at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """merges: left id, right id, id of the result, in order of rank."""
        left, right, made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.left, self.right, self.made = left, right, made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: all words' ids, one after another; starts: where each word begins, with the end of the last. Returns the same after all merges."""
        n = len(symbols)
        if n == 0:
            return symbols, starts
        symbol = symbols.astype(np.int64)
        nxt = np.arange(1, n + 1)
        prev = np.arange(-1, n - 1)
        nxt[starts[1:][starts[1:] > 0] - 1] = n
        prev[starts[:-1][starts[:-1] < n]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the index."""
            at = at[nxt[at] < n]
            if not len(at):
                return
            rank = self.ranks(symbol[at], symbol[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                r = int(rank[lo])
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)

        add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, made = self.left[r], self.right[r], self.made[r]
            at = at[alive[at] & (symbol[at] == a)]
            after = nxt[at]
            at = at[after < n]
            at = at[symbol[nxt[at]] == b]
            if a == b and len(at) > 1:
                at = np.sort(at)
                taken, end = [], -1
                for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):  # in a run of the same symbol, from the left
                    if p != end:
                        taken.append(p)
                        end = q
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = nxt[at]
            alive[gone] = False
            symbol[at] = made
            nxt[at] = nxt[gone]
            has = nxt[at] < n
            prev[nxt[at[has]]] = at[has]
            before = prev[at]
            before = before[before >= 0]
            add(np.unique(np.concatenate([before, at])) if len(before) else at)
        ends = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], ends[starts]


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _runs(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """The values joined up to each end, from the one before on. values: large_binary, without nulls."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset :] if len(values) else np.zeros(1, np.int64)
    bounds = offsets[np.concatenate([[0], ends]).astype(np.int64)]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), values.buffers()[2] or pa.py_buffer(b"")])


class WordBPE:
    """A byte-level BPE with a word-end mark, read from a `tokenizers` file: NFC, white space dropped, lower case."""

    def __init__(self, path: str, entries: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern.replace(r"\s", _SPACE))
        self.ascii_parts = re.compile(pattern.replace(r"\s", _SPACE).replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"))
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_at = np.zeros(1 << 16, np.uint8)
        self.byte_at[list(map(ord, symbols))] = np.arange(256)
        self.spaced = pa.array([f"{self.tokens[i]} " if i in self.tokens else "" for i in range(max(self.tokens) + 1)], pa.large_string()).cast(pa.large_binary())
        self.number, self.used = Numbers(), np.zeros(0, np.int32)
        self.ids = self.names = pa.array([], pa.large_binary())  # of each numbered word
        self.entries = entries

    def split(self, text: str) -> list[str]:
        """Words between white space, in lower case where the whole text is ASCII; special strings whole, with a space before them that no word has (a text may also hold one in upper case, which is a plain word)."""
        if self.cut and "<|" in text:
            out = []
            for k, piece in enumerate(self.cut.split(text)):
                out += [f" {piece}"] if k % 2 else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else text
        return [w for w in _SPACES.split(text) if w] if _ODD.search(text) else text.split()

    def _cut(self, word: str) -> list[bytes]:
        """The pre-tokens of a word, as bytes."""
        if word.isascii():
            return [p.encode() for p in self.parts.findall(word.lower())]
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))]

    def _cut_each(self, words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all pre-tokens of the words, the length of each pre-token, and the number of them in each word."""
        parts = [self._cut(w) for w in words]
        flat = [p for ps in parts for p in ps]
        return b"".join(flat), np.fromiter(map(len, flat), np.int64, len(flat)), np.fromiter(map(len, parts), np.int64, len(parts))

    def _cut_ascii(self, words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """As _cut_each(), of ASCII words: no pre-token goes across a space, so all words are cut as one text."""
        flat = self.ascii_parts.findall(" ".join(words).lower())
        sizes, ends = np.fromiter(map(len, flat), np.int64, len(flat)), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if sizes.sum() != (ends[-1] if len(ends) else 0):  # some characters are in no pre-token
            return self._cut_each(words)
        return "".join(flat).encode(), sizes, np.diff(np.searchsorted(np.cumsum(sizes), ends, side="right"), prepend=0)

    def _cut_other(self, words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """As _cut_each(), of words that are not ASCII, by one call of the library for TOGETHER words: nothing composes with a space."""
        out = []
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            text = self.normalizer.normalize_str(" ".join(some))
            lengths = np.fromiter(map(len, text.split(" ")), np.int64)
            found = self.pre_tokenizer.pre_tokenize_str(text)
            if len(lengths) != len(some):  # a space that is no word's end
                out.append(self._cut_each(some))
                continue
            flat = [p for p, _ in found]
            begins = np.fromiter([at[0] for _, at in found], np.int64, len(found))
            counts = np.diff(np.searchsorted(begins, np.cumsum(lengths + 1)), prepend=0)
            data = self.byte_at[np.frombuffer("".join(flat).encode("utf-16-le"), "<u2")].tobytes()
            out.append((data, np.fromiter(map(len, flat), np.int64, len(flat)), counts))
        if not out:
            return self._cut_each([])
        return b"".join([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])

    def learn(self, new: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of each word, as bytes, and its decoded tokens with a space after each."""
        plain, other, special = [], [], []
        for k, w in enumerate(new):
            (special if w[0] == " " else plain if w.isascii() else other).append(k)
        cut = [self._cut_ascii([new[k] for k in plain]), self._cut_other([new[k] for k in other])]
        flat = np.frombuffer(b"".join([c[0] for c in cut]), np.uint8)
        starts = np.concatenate([[0], np.cumsum(np.concatenate([c[1] for c in cut]))]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(np.concatenate([c[2] for c in cut]))]).astype(np.int64)
        symbols = self.inner[flat]
        if len(flat):
            symbols[starts[1:] - 1] = self.last[flat[starts[1:] - 1]]
        ids, starts = self.index.merge(symbols, starts)
        ids = np.concatenate([ids, np.array([self.special[new[k][1:]] for k in special], np.int64)])
        ends = np.concatenate([starts[first][1:], starts[-1] + np.arange(1, len(special) + 1)])
        order = pa.array(np.argsort(np.array(plain + other + special, np.int64)))
        units = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), len(ids), [None, pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.large_binary())
        return tuple(_runs(column, ends).take(order) for column in (units, self.spaced.take(pa.array(ids))))

    def encode_arrays(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Per text the ids as little-endian unsigned 32-bit integers, and the decoded text (UTF-8)."""
        if len(self.number) > self.entries:  # goes on with the words that the last texts had more than once
            keep = np.flatnonzero(np.bincount(self.used, minlength=len(self.number)) > 1)
            words = list(self.number)
            self.number = Numbers(zip([words[k] for k in keep.tolist()], range(len(keep)), strict=True))
            self.ids, self.names = self.ids.take(pa.array(keep)), self.names.take(pa.array(keep))
        number = self.number.__getitem__
        at = [np.fromiter(map(number, words), np.int32, len(words)) for words in map(self.split, texts)]
        if len(self.number) > len(self.ids):
            ids, names = self.learn(list(islice(self.number, len(self.ids), None)))
            self.ids, self.names = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.names, names])
        self.used = np.concatenate([np.zeros(0, np.int32), *at])
        ends, used = np.cumsum(np.fromiter(map(len, at), np.int64, len(at))), pa.array(self.used)
        return _runs(self.ids.take(used), ends), pc.binary_slice(_runs(self.names.take(used), ends), 0, -1)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """As encode_arrays(), as Python objects."""
        ids, decoded = self.encode_arrays(texts)
        return [(a, b.decode()) for a, b in zip(ids.to_pylist(), decoded.to_pylist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The tokens, joined by spaces: the file names no decoder."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.tokens])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (the text that the ids decode to) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        for part, texts in python_chunks(batches, 3 << 20):
            ids, decoded = bpe.encode_arrays(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(pa.binary()), decoded.cast(pa.large_string()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(returned(run), "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    found = encode(docs, path)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
