"""Words and shingles as 64-bit hashes, by numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from .memos import LONG

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers.
MEMO = 120_000


class _Hashes(dict):
    """Word to hash; emptied when it holds MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            self[word] = got
        return got


HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; of the whole sequence if there are fewer."""
    n = len(h) - k + 1
    if n < 1:
        k, n = len(h), 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _MUL + h[i : n + i]
    return mix(out + np.uint64(k))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of the text with A-Z lower-cased; words end at ASCII white space."""
    words = (text or b"").lower().split()
    return np.unique(windows(word_hashes(words), k)) if words else np.empty(0, np.uint64)
