"""Hashed character n-grams of whole batches of texts, in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np


@functools.cache
def _table(kind: str) -> np.ndarray:
    return np.array([getattr(chr(i), kind)() for i in range(0x110000)], bool)


class Chars:
    """Lower-cased code points of texts (bytes or None), all but letters (and digits, if asked) made spaces, and a space before and after each text."""

    def __init__(self, texts: list[bytes | None], digits: bool = False):
        low = [(t or b"").decode("utf-8", "replace").lower() for t in texts]
        cp = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
        self.inside = _table("isalnum" if digits else "isalpha")[cp]
        self.cp = np.where(self.inside, cp, np.uint32(32))
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low], dtype=np.int64)]).astype(np.int64)

    def ngrams(self, longest: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: (n, start of each n-gram, its bucket). A space may only be the first or last character, so it marks the edge of a word."""
        cp, inside = self.cp, self.inside
        h = np.zeros(len(cp), np.uint32)
        whole = np.ones(len(cp), bool)  # nothing but letters between the first and last character
        for n in range(1, longest + 1):
            size = len(cp) - n + 1
            if size <= 0:
                return
            h = h[:size] * np.uint32(0x01000193) + cp[n - 1 :]
            if n >= 3:
                whole = whole[:size] & inside[n - 2 : n - 2 + size]
                at = np.flatnonzero(whole)
            else:
                at = np.flatnonzero(inside if n == 1 else inside[:-1] | inside[1:])
            x = h[at] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            yield n, at, (x >> np.uint32(32 - bits)).astype(np.int32)

    def sums(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum of the values whose n-grams start in each text."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return np.diff(total[np.searchsorted(at, self.base)])

    def counts(self, at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, self.base))
