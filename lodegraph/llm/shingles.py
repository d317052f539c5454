"""Word shingles as 64-bit hashes.

A word is a run of letters, digits or underscores of the lower-cased text. A
shingle is five words in a row; a text of one to four words is one shingle of
all its words; a text without a word has none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
SIZE = 5
KNOWN = 300_000


class _Known(dict):
    """word -> hash, each computed once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return h


_known = _Known()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all their bits count."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def length(text: str | None) -> int:
    """The words of a text."""
    return len(WORD.findall(text.lower())) if text else 0


def sequence(text: str | None, size: int = SIZE) -> np.ndarray:
    """The hashes of a text's shingles in their order, repeats included."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > KNOWN:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out + np.uint64(min(size, len(h))))


def distinct(text: str | None, size: int = SIZE) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(sequence(text, size))
