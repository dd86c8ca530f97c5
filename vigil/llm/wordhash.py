"""Words of many texts at once, on their UTF-8 bytes: boundaries, hashes, and hashes of runs of words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; such a byte is never part of a longer UTF-8 character.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Longer words are hashed one by one.
LONG_WORD = 48


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits, one for each seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and for each text the index of its first word, with the number of words last."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands."""
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LONG_WORD + 1), kind="stable") if len(starts) else np.zeros(0, np.int64)
    sizes_down = sizes[order]
    letters = mix(np.arange(256, dtype=np.uint64), seed + 101)
    short = order[np.searchsorted(-sizes_down, -LONG_WORD, side="left") :] if len(order) else order
    value = np.zeros(len(short), np.uint64)
    begin, size = starts[short], sizes[short]
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -k, side="left"))  # sizes fall, so the words with more than k bytes come first
        value[:live] = (value[:live] ^ letters[data[begin[:live] + k]]) * factor
        value[:live] ^= value[:live] >> np.uint64(29)
    out[short] = mix(value ^ size.astype(np.uint64), seed)
    for i in order[: len(order) - len(short)].tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def hash_runs(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` consecutive values, by the doubling of powers of two; runs that cross texts are for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, block, length, level = np.full(n, np.uint64(0x51ED270B7A3F5C11)), 0, words, 1, 0
    rest = size
    while rest:
        if rest & 1:
            out = mix(out * np.uint64(0x9FB21C651E98DF25) ^ block[at : at + n], seed)
            at += length
        rest >>= 1
        if rest:
            block = mix(block[:-length] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (block[length:] + np.uint64(level + 1)), seed + 7)
            length *= 2
            level += 1
    return out


def run_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose first words are at `first`: the word indices at which a run of `size` words of one text starts, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][text] + inside, text
