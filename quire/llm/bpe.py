"""Byte-level BPE encoding and decoding in numpy.

Texts are cut where white space follows anything else, which is always a token
boundary; each distinct cut is split into pieces by the tokenizer's pattern, and each
distinct piece that is not itself a token is encoded once, in padded matrices of
similar lengths. In every round each row merges its leftmost pair of minimum rank:
pair ranks come from an open-addressing hash table over (left id, right id), the
merged column is closed up, only the two pairs beside it are looked up again, and
finished rows leave the matrix. A piece of over 512 bytes is a matrix of its own, in which
a round merges all places of the pair of minimum rank where that gives the same. A worker
keeps a bounded cache of cuts between batches. With another pattern than CUTTABLE, whole
texts are split.

A null text counts as empty. Invalid UTF-8 becomes U+FFFD. Input columns named like
an output column are replaced by it. No shuffles.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, others, prepared, quoted
from .words import Numbers, binaries, chunks, gathered

# The 25 white-space characters of Unicode, as a regex set (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The pattern of which CUT's edges are edges of pieces (a fixed value).
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512)
CELLS = 1 << 20
CACHED = 200_000
_NONE = np.int32(2**31 - 1)
_U = np.uint64
_BITS = 21


class PairTable:
    """Rank of the token that a pair of tokens makes, by hash."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(8, (4 * len(left)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, ~_U(0), np.uint64)
        self.vals = np.full(1 << bits, _NONE, np.int32)
        keys = (left.astype(np.uint64) << _U(_BITS)) | right.astype(np.uint64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == ~_U(0)
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.vals[slot[put]] = keys[put], rank[put]
            keys, rank, slot = keys[~put], rank[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_NONE where the pair makes no token, or either side is padding (-1)."""
        out = np.full(len(left), _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.uint64) << _U(_BITS)) | right[at].astype(np.uint64)
        slot = self._slot(keys)
        while len(at):
            got = self.keys[slot]
            hit = got == keys
            out[at[hit]] = self.vals[slot[hit]]
            go = ~hit & (got != ~_U(0))
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & self.mask
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern, self.cuttable = ranks, regex.compile(pattern), pattern == CUTTABLE
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.table = PairTable(left, right, rank.astype(np.int32))
        #: Tokens of which no pair with them makes a token of a lower rank.
        self.last = np.ones(max(ranks.values(), default=0) + 1, bool)
        self.last[left[rank < left]] = self.last[right[rank < right]] = False
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(ranks.values(), default=0) + 1
        self.known, self.token_len = np.zeros(size, bool), np.zeros(size, np.int64)
        rank = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.known[rank], self.token_len[rank] = True, list(map(len, ranks))
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _merge(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges the rows of a padded matrix to the end: (row numbers, ids) of those that end together."""
        rows = np.arange(len(ids))
        n, w = ids.shape
        rank = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, w - 1)
        done = []
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            low = rank[each, at] if rank.shape[1] else np.full(len(rows), _NONE)
            go = low != _NONE
            if not go.all():
                done.append((rows[~go], ids[~go]))
                rows, ids, rank, at, low = rows[go], ids[go], rank[go], at[go], low[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = low
            w = ids.shape[1]
            cols = np.arange(w - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.table.rank(ids[inner, at[inner] - 1], low[inner])
            inner = np.flatnonzero(at < w - 2)
            rank[inner, at[inner]] = self.table.rank(low[inner], ids[inner, at[inner] + 1])
        return done

    def _merge_row(self, ids: np.ndarray) -> np.ndarray:
        """The same for a matrix of one long row. Where no pair beside a merged one can rank lower, the other places of that pair come next anyway, from left to right, so one round merges them all."""
        rank = self.table.rank(ids[:-1], ids[1:])
        while len(rank):
            first = int(rank.argmin())
            low = rank[first]
            if low == _NONE:
                break
            at = np.array([first])
            if self.last[low]:
                at = np.flatnonzero(rank == low)
                # of places that overlap every other one, from the left
                head = np.concatenate([[True], np.diff(at) > 1])
                at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            keep = np.ones(len(rank), bool)
            keep[at] = False
            rank = rank[keep]
            at = at - np.arange(len(at))
            for x in (at[at > 0] - 1, at[at < len(rank)]):
                rank[x] = self.table.rank(ids[x], ids[x + 1])
        return ids

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        direct = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        lens = np.array(list(map(len, pieces)), np.int64)
        count = np.ones(len(pieces), np.int64)
        done = [(np.flatnonzero(direct >= 0), direct[direct >= 0])]
        rest = np.flatnonzero(direct < 0)
        width = np.searchsorted(WIDTHS, lens[rest])
        for i in np.unique(width).tolist():
            some = rest[width == i]
            if i == len(WIDTHS):
                for at in some.tolist():
                    ids = self._merge_row(self.bytes[np.frombuffer(pieces[at], np.uint8)])
                    count[at] = len(ids)
                    done.append((np.array([at]), ids))
                continue
            step = max(1, CELLS // WIDTHS[i])
            for lo in range(0, len(some), step):
                part = some[lo : lo + step]
                ids = np.full((len(part), WIDTHS[i]), -1, np.int32)
                ids[np.arange(WIDTHS[i]) < lens[part, None]] = self.bytes[np.frombuffer(b"".join([pieces[at] for at in part.tolist()]), np.uint8)]
                for rows, got in self._merge(ids):
                    count[part[rows]] = (got >= 0).sum(axis=1)
                    done.append((part[rows], got[got >= 0]))
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for at, ids in done:
            n = count[at]
            out[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def forget(self) -> None:
        """Empties the cache of cuts."""
        self.cuts = Numbers()
        self.ids, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fill(self) -> None:
        """The ids of the new cuts."""
        new, self.cuts.new = self.cuts.new, []
        split = list(map(self.pattern.findall, new))
        size = np.array(list(map(len, split)), np.int64)
        own = Numbers()
        at = own.of(chain.from_iterable(split), int(size.sum()))
        flat, count = self.pieces([p.encode() for p in own.new])
        ids, done = gathered(flat, (np.cumsum(count) - count)[at], count[at])
        ends = done[np.cumsum(size)]
        lens = np.diff(ends, prepend=0)
        self.starts, self.lens = np.concatenate([self.starts, len(self.ids) + ends - lens]), np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each begins and the last ends."""
        if len(self.cuts) > CACHED or not self.cuttable:
            self.forget()
        cuts = [CUT.findall(t) if self.cuttable else [t] for t in texts]
        size = np.array(list(map(len, cuts)), np.int64)
        at = self.cuts.of(chain.from_iterable(cuts), int(size.sum()))
        self._fill()
        ids, done = gathered(self.ids, self.starts[at], self.lens[at])
        return ids, done[np.concatenate([[0], np.cumsum(size)])]

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids of all texts, which begin at cut, and where each text's begin and the last's end."""
        at = ids.astype(np.int64)
        if len(at) and (at.max() >= len(self.known) or not self.known[at].all()):
            raise ValueError("an id outside the vocabulary")
        data, done = gathered(self.flat, self.token_start[at], self.token_len[at])
        return data, done[cut]


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One tokenizer, with its cache, for each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe.load(path, pattern)
    return _LOADED[path, pattern]


def _mapped(df: DataFrame, source: str, new: list[T.StructField], work) -> DataFrame:
    prepared(df.sparkSession)
    keep = others(df, *(f.name for f in new))
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + new)

    def run(batches):
        for batch, values in chunks(batches, source):
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*cols, *work(values)], names=[*keep, *(f.name for f in new)])

    return df.mapInArrow(run, schema)


_N, _IDS, _BACK = T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (little-endian unsigned 32-bit integers)."""

    def work(values):
        ids, cut = loaded(path, pattern).encode([(v or b"").decode("utf-8", "replace") for v in values])
        return [pa.array(np.diff(cut)), binaries(ids, cut)]

    return _mapped(docs, text_col, [_N, _IDS], work)


def bpe_decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """tokens with decoded: the bytes of the ids; an id outside the vocabulary is an error, null ids are empty."""

    def work(values):
        ids = np.frombuffer(b"".join(v or b"" for v in values), "<u4")
        cut = np.concatenate([[0], np.cumsum([len(v or b"") // 4 for v in values])]).astype(np.int64)
        return [binaries(*loaded(path, pattern).decode(ids, cut))]

    return _mapped(tokens, ids_col, [_BACK], work)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """bpe_decode(bpe_encode(docs)) in one pass of the workers."""

    def work(values):
        bpe = loaded(path, pattern)
        ids, cut = bpe.encode([(v or b"").decode("utf-8", "replace") for v in values])
        return [pa.array(np.diff(cut)), binaries(ids, cut), binaries(*bpe.decode(ids, cut))]

    return _mapped(docs, text_col, [_N, _IDS, _BACK], work)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe_round_trip(docs_of(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
