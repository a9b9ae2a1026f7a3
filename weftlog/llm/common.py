"""Helpers shared by the text operators: words as columns, hashing of word windows in batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case ASCII letters and what they become; no other letter is touched.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast built-in."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


#: What the op2/op8 words are separated by, and white space.
NO_WORD, BLANKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x20\x09-\x0D]+"
#: What separates the same words before A-Z are lowered.
NO_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def pieces(c: Column, separator: str) -> Column:
    """What stands between runs of separators, as an array (null: empty).

    Splitting gives an empty string at an end where a separator stands, and nowhere else.
    """
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separator), "")


def words_of(c: Column) -> Column:
    """The op2/op8 words of a text, as an array without empty strings (null: empty)."""
    return pieces(ascii_lower(c), NO_WORD)


# --- hashing of white-space separated words in whole batches -------------------------------------

_RNG = np.random.default_rng(20240607)
#: One random 64-bit number for each byte value; an odd base and its inverse modulo 2**64.
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 2**64), 2 * n)
        return self.up, self.down


def word_hashes(data: bytes, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word (`[^\\x20\\x09-\\x0D]+`, A-Z lowered) of a UTF-8 text."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    if not len(b):
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True]))))
    start, end = edge[::2], edge[1::2]
    up, down = powers.get(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n consecutive words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n_here = min(n, len(words))
    out = np.full(len(words) - n_here + 1, n_here, np.uint64)
    for k in range(n_here):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return np.unique(out)
