"""Benchmark decontamination by winnowing.

Of the hashes of all k-grams, the smallest in each run of `span - k + 1` is kept, in
documents and in benchmark items alike. Any shared span of `span` words then holds a
k-gram that both sides keep, so joining the kept fingerprints misses no such span.
Each hit is extended: the windows of `span` words around it are looked up, by two
64-bit hashes, among the items' windows. An item of fewer words is one window of its
own length, with a fingerprint of that whole length.

Benchmarks are dealt to blocks of at most BLOCK_BYTES of text by hash, and each
block's index is broadcast in a pass of its own over the documents, so what is
broadcast is bounded whatever the benchmark's size. Documents are never shuffled.

Nulls: a null text has no words and no windows; hits in an item with a null id count,
but no item is named for them. Repeated items are one item. Empty tables give no hits.
Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, others, prepared, quoted, shared_dir, written
from .words import ALNUM_WORDS, Words, chunks, mix, window_hashes

SPAN = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
#: (text, item) pairs expanded at a time.
PAIRS = 1 << 20
_U = np.uint64


def winnowed(grams: np.ndarray, at: np.ndarray, n_words: int, run: int) -> np.ndarray:
    """Words at which a kept k-gram starts. grams: the k-gram hash from each word (any value where none fits); at: first words of the windows; run: k-grams in a window."""
    if not len(at):
        return at
    low = np.zeros(n_words, np.uint64)
    least = grams[at]
    for i in range(1, run):
        least = np.minimum(least, grams[at + i])
    low[at] = least
    most = low.copy()
    for i in range(1, run):
        most[i:] = np.maximum(most[i:], low[: n_words - i])
    return np.flatnonzero((most == grams) & (most > 0))


def _grams(w: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    at, _ = w.windows(k)
    out = np.zeros(len(hashes), np.uint64)
    out[at] = window_hashes(hashes, at, k, 3)
    return out


class _Windows:
    """Windows of one length in the items: sorted hashes, the items of each, and the kept fingerprints behind a small bitmap."""

    def __init__(self, prints: np.ndarray, h1: np.ndarray, h2: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, h2, h1))
        h1, h2, item = h1[order], h2[order], item[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (item[1:] != item[:-1])])
        h1, h2, item = h1[new], h2[new], item[new]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        self.h1, self.h2 = h1[new], h2[new]
        self.cut, self.item = np.append(np.flatnonzero(new), len(item)), item
        # the first window with the same items stands for all of them
        _, first, back = np.unique(np.add.reduceat(mix(item.astype(np.uint64)), self.cut[:-1]) if len(item) else h1, return_index=True, return_inverse=True)
        self.like = first[back]
        self.prints = np.unique(prints)
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(self.prints >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.bits = np.packbits(bits)

    def hit(self, prints: np.ndarray) -> np.ndarray:
        cell = (prints >> _U(64 - FILTER_BITS)).astype(np.int64)
        maybe = np.flatnonzero((self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & np.uint8(1))
        at = np.minimum(np.searchsorted(self.prints, prints[maybe]), len(self.prints) - 1)
        return maybe[self.prints[at] == prints[maybe]]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each window here, or -1."""
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)


def index_items(names: list, texts: list[bytes | None], span: int, k: int) -> tuple[list, dict[int, _Windows]]:
    """The items' names, and their windows by length."""
    w = Words(texts, ALNUM_WORDS, lower=True)
    hashes, counts = w.hashes(), w.counts
    out = {}
    at, doc = w.windows(span)
    if len(at):
        grams = _grams(w, hashes, k)
        kept = winnowed(grams, at, len(hashes), span - k + 1)
        out[span] = _Windows(grams[kept], window_hashes(hashes, at, span, 1), window_hashes(hashes, at, span, 2), doc)
    for size in sorted(set(counts[(counts > 0) & (counts < span)].tolist())):
        doc = np.flatnonzero(counts == size)
        at = w.first[doc]
        h1, h2 = window_hashes(hashes, at, size, 1), window_hashes(hashes, at, size, 2)
        out[size] = _Windows(h1, h1, h2, doc)
    return names, out


def find_hits(texts: list[bytes | None], windows: dict[int, _Windows], span: int, k: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, which of them are hit, and the distinct (text, item) pairs."""
    w = Words(texts, ALNUM_WORDS, lower=True)
    hashes = w.hashes()
    step = np.zeros(len(hashes) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    doc_of = w.doc_of_word()
    for size, index in windows.items():
        at, _ = w.windows(size)
        if not len(at):
            continue
        if size == span:
            grams = _grams(w, hashes, k)
            kept = winnowed(grams, at, len(hashes), span - k + 1)
            kept = kept[index.hit(grams[kept])]
            # extend: every window of the same text that covers the fingerprint
            fits = np.zeros(len(hashes), bool)
            fits[at] = True
            near = (kept[:, None] - np.arange(span - k + 1)).reshape(-1)
            near = np.unique(near[near >= 0])
            at = near[fits[near]]
            h1 = window_hashes(hashes, at, size, 1) if len(at) else hashes[:0]
        else:
            h1 = window_hashes(hashes, at, size, 1)
            some = index.hit(h1)
            at, h1 = at[some], h1[some]
        if not len(at):
            continue
        found = index.find(h1, window_hashes(hashes, at, size, 2))
        at, found = at[found >= 0], found[found >= 0]
        if not len(at):  # fingerprints alone are shared
            continue
        np.add.at(step, at, 1)
        np.add.at(step, at + size, -1)
        # a text's distinct sets of items, then the items of each, some sets at a time
        doc, window = np.divmod(np.unique(doc_of[at] * len(index.like) + index.like[found]), len(index.like))
        n = index.cut[window + 1] - index.cut[window]
        done = np.cumsum(n)
        for lo, hi in zip(cuts := [0, *np.unique(np.searchsorted(done, np.arange(PAIRS, done[-1], PAIRS)) + 1).tolist(), len(n)], cuts[1:]):
            first, m = index.cut[window[lo:hi]], n[lo:hi]
            which = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
            pairs.append(np.unique((np.repeat(doc[lo:hi], m) << 32) | index.item[which]))
    both = np.unique(np.concatenate(pairs))
    return w, np.cumsum(step)[:-1] > 0, both >> 32, both & 0xFFFFFFFF


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_hit (words inside a window that an item holds), items (their ids as sorted strings), hit_spans (start and end in words of each hit run) and contaminated."""
    spark = prepared(docs.sparkSession)
    sc = spark.sparkContext
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    keep = others(docs, "n_words", "n_hit", "items", "hit_spans", "contaminated")
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    state = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", span_type)]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + state)
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = docs.select(*(quoted(c) for c in keep))
    where = shared_dir(spark) if blocks > 1 else ""
    for b in range(blocks):
        table = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toArrow()
        index = index_items(table.column("item").to_pylist(), [t.encode() for t in table.column("text").to_pylist()], span, gram)
        shared = sc.broadcast(index)

        def run(batches, shared=shared, again=b > 0):
            names, windows = shared.value
            for batch, texts in chunks(batches, text_col):
                w, hit, doc, item = find_hits(texts, windows, span, gram)
                if again:  # with the spans that earlier blocks found
                    for i, spans in enumerate(batch.column("hit_spans").to_pylist()):
                        for s in spans:
                            hit[w.first[i] + s["start"] : w.first[i] + s["end"]] = True
                named: list[set] = [set() for _ in texts]
                for d, i in zip(doc.tolist(), item.tolist()):
                    if names[i] is not None:
                        named[d].add(names[i])
                if again:
                    for s, more in zip(named, batch.column("items").to_pylist()):
                        s.update(more)
                spans: list[list] = [[] for _ in texts]
                of = w.doc_of_word()
                on = np.flatnonzero(hit)
                if len(on):
                    cut = np.flatnonzero((np.diff(on) != 1) | (of[on][1:] != of[on][:-1])) + 1
                    for run_ in np.split(on, cut):
                        d = int(of[run_[0]])
                        spans[d].append({"start": int(run_[0] - w.first[d]), "end": int(run_[-1] - w.first[d]) + 1})
                cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.record_batch([*cols, pa.array(w.counts), pa.array([sorted(s) for s in named], pa.list_(pa.string())), pa.array(spans, arrow_spans)], names=[*keep, "n_words", "items", "hit_spans"])

        out = out.mapInArrow(run, schema)
        if blocks > 1:
            out = written(out, f"{where}/{b}")
            shared.destroy()
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    done = decontaminate(docs, docs_of(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, least(len(ws), 10) AS n, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM v),
ns AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n),
h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN w ON w.n = p.n AND w.k = array_to_string(p.ws[i:i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
