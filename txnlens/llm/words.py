"""Words and word hashes inside Arrow tasks."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"\w+")
LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 1 << 16
_SLICE_ROWS = 256


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower()) if text else []


def text_slices(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, few at a time, so that a task holds few Python strings."""
    for at in range(0, len(batch), _SLICE_ROWS):
        yield batch.slice(at, _SLICE_ROWS).to_pylist()


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that mixes all bits (splitmix64)."""
    x = (x + _MIX) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive words; a shorter text, if not empty, is one shingle of all its words."""
    if not len(hashed):
        return hashed
    size = min(size, len(hashed))
    out = np.zeros(len(hashed) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = scramble(out ^ hashed[k:len(hashed) - size + 1 + k])
    return out
