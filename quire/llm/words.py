"""Words and word-window hashes of whole batches of texts, in numpy.

Texts are joined into one byte buffer, each followed by a space, so that every
word of every text ends at a separator byte and a batch is split, hashed and
windowed without a Python loop over words. Hashes are 64-bit polynomials modulo
2**64 over random byte values, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 2048

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASES = [_U(int(x) | 3) for x in _rng.integers(2**60, 2**63, 4, dtype=np.uint64) & ~_U(7)]
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: True at the bytes of words: everything but ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False
#: True at lower-case letters, digits and all bytes of non-ASCII characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(31))
    h *= _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    h ^= h >> _U(33)
    return h


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    got = _TABLES.get(which)
    if got is None or len(got[0]) < n:
        base = int(_BASES[which])
        size = max(n, 1 << 16)
        fwd = np.full(size, base, np.uint64)
        inv = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        fwd[0] = inv[0] = 1
        got = np.cumprod(fwd, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:  # tables for one enormous text are not kept
            _TABLES[which] = got
    return got


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, independent of its place."""
    fwd, inv = _powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * fwd[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


class Words:
    """The words of a list of texts (bytes or None).

    buf: all bytes, each text followed by one space; starts, ends: of each word
    in buf; first: for each text the number of words before it, and the total.
    """

    def __init__(self, texts: list[bytes | None], letters: np.ndarray = SPACE_WORDS, lower: bool = False):
        self.n = len(texts)
        joined = b" ".join([t or b"" for t in texts]) + b" "
        raw = np.frombuffer(joined, np.uint8)
        self.buf = LOWER[raw] if lower else raw
        inside = letters[self.buf].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, self.n)
        self.base = np.zeros(self.n + 1, np.int64)
        np.cumsum(lens + 1, out=self.base[1:])
        self.first = np.searchsorted(self.starts, self.base)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.buf], self.starts, self.ends, 0)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and text index of each window of k words inside one text."""
        room = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(self.n), room)
        skipped = np.repeat(self.first[:-1] - (np.cumsum(room) - room), room)
        return np.arange(len(doc)) + skipped, doc

    def strings(self) -> list[bytes]:
        data = self.buf.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hash of the k word hashes from each index in at."""
    return span_hashes(hashes, at, at + k, which)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def chunks(batches, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of record batches with at most CHUNK_ROWS rows and, unless one text alone has more, CHUNK_BYTES of text; with their texts."""
    for batch in batches:
        i = batch.schema.get_field_index(text)
        whole = bytes_of(batch.column(i))
        lo = size = 0
        for hi, t in enumerate(whole):
            n = len(t) if t else 0
            if hi > lo and (size + n > CHUNK_BYTES or hi - lo >= CHUNK_ROWS):
                yield batch.slice(lo, hi - lo), whole[lo:hi]
                lo, size = hi, 0
            size += n
        if lo < len(whole):
            yield batch.slice(lo), whole[lo:]
    trim()


def trim() -> None:
    """Gives freed memory back to the system, since idle workers stay beside the busy ones of an executor."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Numbers(dict):
    """Keys, numbered in the order of their first use; new: those added since it was last emptied."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n

    def of(self, keys, size: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, size)


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of flat one after the other, and where each begins and the last ends."""
    done = np.concatenate([[0], np.cumsum(lens)])
    return flat[np.repeat(starts - done[:-1], lens) + np.arange(done[-1])], done


def binaries(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The slices of data between the elements of cut, as bytes."""
    cut = pa.py_buffer((cut * data.itemsize).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(cut) // 8 - 1, [None, cut, pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
