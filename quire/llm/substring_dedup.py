"""Exact substring dedup with a count-min prefilter.

1. Documents are dealt to blocks by hash. A block sketches its distinct word windows
   in two rows of counters. A sketch is sparse: it is shipped as gaps between cell
   numbers (about two bytes a cell), in segments of the rows that merge independently.
2. The merge of a segment answers each block with one bit a cell, "held by two blocks
   or more". With its own counts a block then knows which of its windows have two
   counters that reach two. Counters only ever overestimate, so no repeated window is
   lost. The rows grow with the input (LOAD counters or more for each window), so at any
   size about one in a hundred windows that occur once passes; nothing is broadcast.
3. A block sends each estimated-repeated window once (96-bit hash, smallest doc_id in
   the block) to the bucket of its hash, where windows are grouped exactly. A window
   that a third of all documents hold reaches a bucket once per block, not once per
   document.
4. A bucket answers each block with one bit a window, "some other block has a
   smaller doc_id". The block derives its windows again and marks the words.

Blocks, segments and buckets are as many as the input needs for each to stay small.

Nulls: a null text has no words; a row with a null id comes after all other
documents. Rows with equal ids never remove each other's words. Empty tables give
empty results. Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, prepared, quoted
from .words import Words, bytes_of, mix, window_hashes

WINDOW = 13
LOAD = 8
WORD_BYTES = 6
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 256
LAST = np.iinfo(np.int64).max
_U = np.uint64


class Sketch(NamedTuple):
    """The shape of a count-min sketch: rows of 2**width counters in 2**segments segments; gaps are shipped as numbers of a type."""

    width: int
    segments: int
    gap: str

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """The counter of each hash in one of the two rows."""
        return (mix(h ^ _U(0xA5A5A5A55A5A5A5A)) if row else h) >> _U(64 - self.width)

    def cuts(self, c: np.ndarray) -> np.ndarray:
        """Where each segment's part of sorted cells ends."""
        bound = np.arange(1, 1 << self.segments, dtype=np.uint64) << _U(self.width - self.segments)
        return np.concatenate([[0], np.searchsorted(c, bound), [len(c)]])


def sketch_for(size: int, blocks: int) -> Sketch:
    """A sketch for some bytes of text, taken to hold a word in each WORD_BYTES."""
    width = max(24, (LOAD * size // WORD_BYTES).bit_length())
    # gaps average 8 to 16 times the blocks: short numbers while they mostly fit, since a gap too long takes several
    return Sketch(width, max(8, (blocks - 1).bit_length()), "<u2" if LOAD * blocks <= 1 << 15 else "<u4")


def packed(c: np.ndarray, sketch: Sketch):
    """(segment, payload) of sorted distinct cells: the gaps before them, from the segment's start; the type's largest number adds to the next."""
    if not len(c):
        return
    most = np.iinfo(sketch.gap).max
    cut = sketch.cuts(c)
    seg = np.flatnonzero(np.diff(cut))
    gap = np.diff(c, prepend=_U(0))
    gap[cut[seg]] = c[cut[seg]] - (seg.astype(np.uint64) << _U(sketch.width - sketch.segments))
    last = np.cumsum(gap // _U(most) + _U(1)).astype(np.int64)
    out = np.full(last[-1], most, sketch.gap)
    out[last - 1] = gap % _U(most)
    ends = np.concatenate([[0], last])[cut].tolist()
    for s in seg.tolist():
        yield s, out[ends[s] : ends[s + 1]].tobytes()


def unpacked(payload: bytes, gap: str) -> np.ndarray:
    """The cells of a payload, from its segment's start."""
    g = np.frombuffer(payload, gap)
    return np.cumsum(g, dtype=np.uint64)[g != np.iinfo(gap).max]


def _merger(gap: str):
    def run(table: pa.Table) -> pa.Table:
        """Adds the sketches of one segment; for each cell of each, whether another block holds it too."""
        parts = [unpacked(p, gap) for p in table.column("payload").to_pylist()]
        v = np.concatenate(parts)
        ranked = np.sort(v)
        again = ranked[1:][ranked[1:] == ranked[:-1]]
        twice = np.zeros(len(v), bool) if not len(again) else again[np.minimum(np.searchsorted(again, v), len(again) - 1)] == v
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
        bits = [np.packbits(twice[i:j]).tobytes() for i, j in zip(cut, cut[1:])]
        return pa.table({c: table.column(c) for c in ("block", "r", "seg")} | {"bits": pa.array(bits, pa.binary())})

    return run


def _scanned(texts: list, k: int) -> list[tuple]:
    """(first text, their words, word hashes, places, texts, window hashes) of some MB of texts at a time that have windows."""
    found = []
    size, lo = 0, 0
    for hi in range(len(texts) + 1):
        n = len(texts[hi] or b"") if hi < len(texts) else 0
        if hi > lo and (hi == len(texts) or size + n > (2 << 20)):
            w = Words(texts[lo:hi])
            at, doc = w.windows(k)
            if len(at):
                hashes = w.hashes()
                found.append((lo, w.first, hashes, at, doc, window_hashes(hashes, at, k)))
            lo, size = hi, 0
        size += n
    return found


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def _ranked(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a block in the order of their hashes: that order, the hashes, and where each distinct one starts."""
    h = np.concatenate([f[5] for f in found])
    order = np.argsort(h)  # equal hashes may come in any order: nothing depends on it
    h = h[order]
    return order, h, _starts(h)


def _estimated(found: list[tuple], ranked: tuple, sketch: Sketch, replies: tuple[list, list]) -> np.ndarray:
    """For each distinct window hash of a block, in order, whether the smaller of its two counters reaches two. replies: for each row, the segments' answers."""
    order, h, new = ranked
    doc = np.concatenate([f[4] + f[0] for f in found])[order]
    # more than one where documents change within a run: a text's own repeats are no repeat between documents
    held = np.add.reduceat((new | _starts(doc)).astype(np.int64), np.flatnonzero(new))
    h = h[new]
    est = np.ones(len(h), bool)
    for row in (0, 1):
        c = sketch.cells(h, row)
        order = np.argsort(c)
        c = c[order]
        first = _starts(c)
        reach = np.add.reduceat(held[order], np.flatnonzero(first)) >= 2
        cut = sketch.cuts(c[first])
        for seg, bits in replies[row]:
            i, j = cut[seg], cut[seg + 1]
            reach[i:j] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
        est[order] &= reach[np.cumsum(first) - 1]
    return est


def _candidates(found: list[tuple], ranked: tuple, ids: np.ndarray, est: np.ndarray, k: int):
    """A block's estimated-repeated windows, the same for any order of its rows: distinct windows by hash with their smallest id, and for each occurrence (text, word) its window."""
    if not found or not est.any():
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint32), e, e, e, e
    order, _, new = ranked
    on = np.empty(len(order), bool)
    on[order] = est[np.cumsum(new) - 1]
    parts, done = [], 0
    for lo, first, hashes, at, doc, h in found:
        keep = np.flatnonzero(on[done : done + len(h)])
        done += len(h)
        at, doc, h = at[keep], doc[keep], h[keep]
        h2 = window_hashes(hashes, at, k, 2) if len(at) else h
        parts.append((h, (h2 >> _U(32)).astype(np.uint32), doc + lo, at - first[doc]))
    h, h2, doc, word = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids[doc], h2, h))
    h, h2, doc, word = h[order], h2[order], doc[order], word[order]
    new = _starts(h) | _starts(h2)
    entry = np.cumsum(new) - 1
    return h[new], h2[new], ids[doc[new]], doc, word, entry


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy().astype(np.int64)


def _cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted hashes ends: buckets are ranges of the high bits."""
    bound = np.arange(1, buckets, dtype=np.uint64) << _U(65 - buckets.bit_length())
    return np.concatenate([[0], np.searchsorted(h, bound), [len(h)]])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words, joined by one space, that no window covers which also starts in a document with a smaller id."""
    prepared(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    buckets = 1 << max(8, (blocks - 1).bit_length())
    sketch = sketch_for(size, blocks)

    rest = others(docs, "n_words", "n_removed", "kept_text")
    blk = F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(blocks)).cast("int")
    dealt = docs.select(quoted(id_col).cast("long").alias("__quire_id"), blk.alias("__quire_block"), *(quoted(c) for c in rest))

    def count(table: pa.Table) -> pa.Table:
        found = _scanned(bytes_of(table.column(text_col)), window)
        rows = []
        if found:
            h = np.sort(np.concatenate([f[5] for f in found]))
            h = h[_starts(h)]
            for r in (0, 1):
                c = np.sort(sketch.cells(h, r))
                rows += [(r, seg, payload) for seg, payload in packed(c[_starts(c)], sketch)]
        return pa.table({"block": pa.array([table.column("__quire_block")[0].as_py()] * len(rows), pa.int32()), "r": pa.array([x[0] for x in rows], pa.int32()), "seg": pa.array([x[1] for x in rows], pa.int32()), "payload": pa.array([x[2] for x in rows], pa.binary())})

    def ask(table: pa.Table, bits: pa.Table) -> pa.Table:
        found = _scanned(bytes_of(table.column(text_col)), window)
        rows = []
        if found:
            block = table.column("__quire_block")[0].as_py()
            replies: tuple[list, list] = ([], [])
            for r, seg, b in zip(*(bits.column(c).to_pylist() for c in ("r", "seg", "bits"))):
                replies[r].append((seg, b))
            ranked = _ranked(found)
            est = _estimated(found, ranked, sketch, replies)
            h, h2, low, *_ = _candidates(found, ranked, _ids(table.column("__quire_id")), est, window)
            cut = _cuts(h, buckets)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                i, j = cut[b], cut[b + 1]
                rows.append((block, b, False, h[i:j].tobytes() + h2[i:j].tobytes() + low[i:j].tobytes()))
            rows.append((block, block % buckets, True, np.packbits(est).tobytes()))  # to be handed back as it is
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["block", "bucket", "own", "payload"])

    def answer(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("own")).rename_columns(["block", "bucket", "own", "flags"])
        table = table.filter(pc.invert(table.column("own")))
        if not table.num_rows:
            return own
        got = table.column("payload").to_pylist()
        n = [len(p) // 20 for p in got]
        h = np.concatenate([np.frombuffer(p, np.uint64, m) for p, m in zip(got, n)])
        h2 = np.concatenate([np.frombuffer(p, np.uint32, m, 8 * m) for p, m in zip(got, n)])
        low = np.concatenate([np.frombuffer(p, np.int64, m, 12 * m) for p, m in zip(got, n)])
        order = np.lexsort((low, h2, h))
        h, h2, low = h[order], h2[order], low[order]
        new = _starts(h) | _starts(h2)
        flag = np.empty(len(h), bool)
        flag[order] = low > low[new][np.cumsum(new) - 1]
        cut = np.concatenate([[0], np.cumsum(n)]).tolist()
        flags = pa.array([np.packbits(flag[i:j]).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
        return pa.concat_tables([own, table.select(["block", "bucket", "own"]).append_column("flags", flags)])

    out_schema = T.StructType([f for f in docs.schema.fields if f.name in rest] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def strike(table: pa.Table, flags: pa.Table) -> pa.Table:
        texts = bytes_of(table.column(text_col))
        ids = _ids(table.column("__quire_id"))
        found = _scanned(texts, window)
        replies = {b: f for b, own, f in zip(*(flags.column(c).to_pylist() for c in ("bucket", "own", "flags"))) if not own}
        est, ranked = np.zeros(0, bool), ()
        for f in flags.filter(flags.column("own")).column("flags").to_pylist():
            ranked = _ranked(found)
            est = np.unpackbits(np.frombuffer(f, np.uint8), count=int(ranked[2].sum())).astype(bool)
        h, _, low, doc, word, entry = _candidates(found, ranked, ids, est, window)
        del found, ranked
        cut = _cuts(h, buckets)
        later = np.zeros(len(h), bool)
        for b, f in replies.items():
            i, j = cut[b], cut[b + 1]
            later[i:j] = np.unpackbits(np.frombuffer(f, np.uint8), count=j - i).astype(bool)
        hit = later[entry] | (ids[doc] > low[entry])
        doc, word = doc[hit], word[hit]
        order = np.argsort(doc, kind="stable")
        doc, word = doc[order], word[order]
        n_words, n_removed, kept = [], [], []
        for lo in range(0, len(texts), 256):
            w = Words(texts[lo : lo + 256])
            i, j = np.searchsorted(doc, [lo, lo + 256])
            at = w.first[doc[i:j] - lo] + word[i:j]
            step = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            gone = np.cumsum(step)[:-1] > 0
            mark = np.zeros(len(w.buf) + 1, np.int8)
            mark[w.starts[~gone]] = 1
            mark[w.ends[~gone] + 1] = -1  # with the separator after the word; the next word starts there at the earliest
            both = w.starts[~gone][1:] == w.ends[~gone][:-1] + 1
            mark[w.starts[~gone][1:][both]] = 0
            keep = np.cumsum(mark[:-1]) > 0
            clean = np.where(np.isin(w.buf, (9, 10, 11, 12, 13)), np.uint8(32), w.buf)
            data = clean[keep].tobytes()
            ends = np.concatenate([[0], np.cumsum(keep)])[w.base].tolist()
            kept += [data[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            n_words += w.counts.tolist()
            n_removed += np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first]).tolist()
        cols = {c: table.column(c) for c in rest}
        return pa.table(cols | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    by_block = dealt.groupBy("__quire_block")
    bits = by_block.applyInArrow(count, "block int, r int, seg int, payload binary").groupBy("r", "seg").applyInArrow(_merger(sketch.gap), "block int, r int, seg int, bits binary")
    asked = by_block.cogroup(bits.groupBy("block")).applyInArrow(ask, "block int, bucket int, own boolean, payload binary")
    flags = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, own boolean, flags binary")
    return by_block.cogroup(flags.groupBy("block")).applyInArrow(strike, out_schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import docs_of

    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS low FROM k GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (k) WHERE doc_id > low),
g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
o AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
  CASE WHEN js IS NULL THEN array_to_string(ws, ' ')
  ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(js, x)), lambda x: ws[x]), ' ') END AS kept
  FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM o
"""
