"""Helpers of several operators: hashing in numpy, words, and Arrow plumbing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}\s]+")
#: A word-hash cache is emptied beyond this many entries, so a worker's memory doesn't follow the vocabulary.
CACHE_WORDS = 500_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bare_words(text: str) -> list[str]:
    """Words: what is neither letter, digit nor white space deleted, then parted at white space of any kind."""
    return _NOT_WORD.sub("", text).split()


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def offsets_of(lengths) -> np.ndarray:
    """Start offsets (one more than the parts) of parts with these lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow list column of these parts of ``values``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as Spark's signed ones, bit by bit."""
    return x.astype(np.uint64).view(np.int64)
