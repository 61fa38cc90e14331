"""Vectorised hashes of word sequences, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _powers, _inverse
    if _powers.size < n:
        size = max(n, 2 * _powers.size)
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers, _inverse = made
    return _powers, _inverse


class Sequence:
    """64-bit hashes of any stretch of a word sequence, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: np.ndarray):
        power, self.back = _grown(words.size + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words) * power[: words.size], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end, for arrays of starts and ends."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
