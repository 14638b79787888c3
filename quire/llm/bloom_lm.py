"""Language-model scoring from a log-frequency Bloom filter.

A count c has level 1 + floor(log2 c). A filter holds (n-gram, j) for each j up to the
level of the n-gram's count, with `hashes` bits each, for words and for word pairs. It is
made of segments, one a bucket of the hash range; a segment has the least power of two
of bits that its insertions leave at most half full, so every counted n-gram is in it
and the error of a probe is bounded at any size. A level is read back by probing
j = 1, 2, ... until one is missing; it stands for the middle of its counts. With f for
these counts,
P(w | u) = WEIGHT * min(1, f(u, w) / f(u)) + (1 - WEIGHT) * (f(w) + 1) / (N + V + 1),
where u is the word before, or the end mark at the start of a text.

The filter grows with the corpus. Where the training texts have at most SMALL bytes, so
that it is proven small (an n-gram takes two bytes of text at least), it is gathered and
broadcast with the exact counts of words, and documents are not shuffled. Else:

1. Documents are dealt to blocks by hash. A block sends its distinct n-grams, with how
   often its training texts hold them, to the buckets of their hashes.
2. A bucket adds up the counts, builds its segment, probes the n-grams asked, and
   answers each block with one level an n-gram and, for words, the exact count.
3. The block derives its n-grams again and adds up the scores of its documents.

Buckets follow the size of the input, so that one is a few MB. Both ways build the same
segments for the same buckets. Words are told apart by 63-bit hashes, pairs by 40 bits
inside their bucket. An n-gram that all documents hold reaches a bucket once a block.

A null text is an empty one: just its end mark. Rows whose flag is false
or null are scored only. Nulls and repeats in other columns play no part; an empty table gives
an empty result; without training texts every count is 0. Input columns named like an
output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_rest, docs_of, others, prepared, quoted
from .words import Words, bytes_of, chunks, mix

HASHES = 5
WEIGHT = 0.3
SMALL = 16 << 20
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 64
#: Text for each bucket; about half as many bytes of n-grams go to it.
BUCKET_BYTES = 16 << 20
LEAST_BUCKET_BITS = 8
WORD, PAIR = 0, 1
_U = np.uint64
END = _U(0x1F83D9ABFB41BD6A)
NAMES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with END after each text, hash of the word before each, where each text ends). The lowest bit of a hash is 0."""
    w = Words(texts, lower=True)
    h = np.insert(w.hashes() & ~_U(1), w.first[1:], END)
    ends = w.first[1:] + np.arange(1, w.n + 1)
    before = np.concatenate([[END], h[:-1]]).astype(np.uint64)
    return h, before, ends


def pair_hashes(before: np.ndarray, h: np.ndarray, bucket_bits: int) -> np.ndarray:
    """The bucket and 40 bits of a hash of two words, at the high end."""
    low = _U(24 - bucket_bits)
    return (mix(before * _U(0x9E3779B97F4A7C15) + h) >> low) << low


def level(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of each level; 0 for level 0."""
    top = np.exp2(levels.astype(np.float64))
    return np.where(levels > 0, (top / 2 + top - 1) / 2, 0.0)


# -- what goes between blocks and buckets --------------------------------------------


def _small(n: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow in full."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _counts(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", (len(data) - at - n) // 8, at + n)
    return out


def _packed(kind: int, bucket_bits: int, h: np.ndarray, n: np.ndarray) -> bytes:
    """Words: 8-byte hashes. Pairs: the 40 bits below the bucket. Then the counts."""
    if kind == WORD:
        keys = h.tobytes()
    else:
        low = (h << _U(bucket_bits)) >> _U(24)
        keys = low.astype("<u4").tobytes() + (low >> _U(32)).astype(np.uint8).tobytes()
    return len(h).to_bytes(8, "little") + keys + _small(n)


def _unpacked(kind: int, bucket_bits: int, bucket: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    if kind == WORD:
        return np.frombuffer(data, "<u8", n, 8), _counts(data, n, 8 + 8 * n)
    low = np.frombuffer(data, "<u4", n, 8).astype(np.uint64) | (np.frombuffer(data, np.uint8, n, 8 + 4 * n).astype(np.uint64) << _U(32))
    return (low << _U(24 - bucket_bits)) | (_U(bucket) << _U(64 - bucket_bits)), _counts(data, n, 8 + 5 * n)


def _cuts(h: np.ndarray, bucket_bits: int) -> list[int]:
    """Where each bucket's part of the sorted hashes ends."""
    bound = np.arange(1, 1 << bucket_bits, dtype=np.uint64) << _U(64 - bucket_bits)
    return [0, *np.searchsorted(h, bound).tolist(), len(h)]


def _distinct(h: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and how many of each are in training texts. The lowest bit of a hash is free, so one sort does both."""
    key = np.sort(h | trains)
    own = key >> _U(1)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return key[new] & ~_U(1), np.add.reduceat((key & _U(1)).astype(np.int64), new)


def _asked(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bucket_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, payload) of a block with these (words, words before, whether they train): every bucket of words, so that its totals come back, and the buckets of its pairs."""
    h, before, trains = (np.concatenate(x) for x in zip(*parts))
    for kind, x in ((WORD, h), (PAIR, pair_hashes(before, h, bucket_bits))):
        uniq, n = _distinct(x, trains)
        cut = _cuts(uniq, bucket_bits)
        for b, (i, j) in enumerate(zip(cut, cut[1:])):
            if j > i or kind == WORD:
                yield kind, b, _packed(kind, bucket_bits, uniq[i:j], n[i:j])


# -- the filter ----------------------------------------------------------------------


def _places(h: np.ndarray, j: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The places of (n-gram, j) in a segment of 2**bits bits."""
    each = 64 // bits  # places read from one mix
    g = h
    for i in range(hashes):
        if i % each == 0:
            g = mix(g + _U((j * 64 + i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        yield ((g >> _U(bits * (i % each))) & _U((1 << bits) - 1)).astype(np.int64)


def segment(h: np.ndarray, n: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The packed bits of the n-grams of one bucket with these counts; n-grams of count 0 are left out."""
    q = level(n)
    bits = 6
    while (1 << bits) * np.log(2) / hashes < q.sum():
        bits += 1
    on = np.zeros(1 << bits, bool)
    j = 1
    h, q = h[q >= 1], q[q >= 1]
    while len(h):
        for place in _places(h, j, bits, hashes):
            on[place] = True
        j += 1
        h, q = h[q >= j], q[q >= j]
    return np.packbits(on)


def probe(filter_: np.ndarray, h: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The level of each n-gram in its segment: how many successive (n-gram, j) are members."""
    bits = (8 * len(filter_)).bit_length() - 1
    out = np.zeros(len(h), np.int64)
    at = np.arange(len(h))
    j = 1
    while len(at):
        alive = np.arange(len(at))
        for place in _places(h[at], j, bits, hashes):
            p = place[alive]
            alive = alive[((filter_[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & np.uint8(1)).astype(bool)]
            if not len(alive):
                break
        at = at[alive]
        out[at] = j
        j += 1
    return out


def _merged(kind: int, bucket_bits: int, bucket: int, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct hashes, their counts, for each asked n-gram its number, where each payload's n-grams end)."""
    got = [_unpacked(kind, bucket_bits, bucket, p) for p in payloads]
    h, n = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(h)
    h = h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    total = np.add.reduceat(n[order], first) if len(h) else n
    return h[first], total, entry, np.cumsum([0] + [len(x) for x, _ in got]).tolist()


# -- scores --------------------------------------------------------------------------


def _sums(ends: np.ndarray, f_word: np.ndarray, f_end: float, f_pair: np.ndarray, exact: np.ndarray, total: int, distinct: int) -> list[np.ndarray]:
    """n_tokens, n_known, train_tokens, base_score and score of the texts that end at ends. By token: the middles of the levels of words and pairs, and the words' exact counts; f_end: that of the end mark."""
    f_before = np.concatenate([[f_end], f_word[:-1]])  # after an end mark comes the next text
    share = np.divide(f_pair, f_before, out=np.zeros(len(f_word)), where=f_before > 0)
    log_p = np.log10(WEIGHT * np.minimum(1.0, share) + (1 - WEIGHT) * (f_word + 1) / (total + distinct + 1))
    cut = np.concatenate([[0], ends])
    known, logs, score = (np.diff(np.concatenate([[0], np.cumsum(x)])[cut]) for x in ((exact > 0).astype(np.int64), np.log10(exact + 1.0), log_p))
    n = np.diff(cut)
    return [n, known, np.full(len(n), total, np.int64), logs - n * np.log10(total + distinct + 1), score]


_ASK = "block int, kind int, bucket int, payload binary"
_RESULT = [T.StructField(n, T.DoubleType() if n.endswith("score") else T.LongType()) for n in NAMES]


def _broadcast(docs: DataFrame, trains: str, text_col: str, keep: list[str], schema: T.StructType, hashes: int) -> DataFrame:
    """The scores from a filter that every worker holds."""
    spark, bits = docs.sparkSession, LEAST_BUCKET_BITS

    def count(batches):
        for _, texts in chunks(batches, "text"):
            h, before, _ = tokens(texts)
            rows = list(_asked([(h, before, np.ones(len(h), np.uint64))], bits))
            kind, bucket, payload = zip(*rows)
            yield pa.record_batch([pa.array([0] * len(rows), pa.int32()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], names=["block", "kind", "bucket", "payload"])

    def build(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        h, n, _, _ = _merged(kind, bits, bucket, table.column("payload").to_pylist())
        return pa.table({"kind": [kind], "bucket": [bucket], "bits": [segment(h, n, hashes).tobytes()], "words": [_packed(WORD, bits, h, n) if kind == WORD else b""]}, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("words", pa.binary())]))

    texts = docs.where(quoted(trains)).select(quoted(text_col).cast("string").alias("text"))
    built = texts.mapInArrow(count, _ASK).groupBy("kind", "bucket").applyInArrow(build, "kind int, bucket int, bits binary, words binary").toArrow().to_pylist()
    filters = {(r["kind"], r["bucket"]): np.frombuffer(r["bits"], np.uint8) for r in built}
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    words, counts = (np.concatenate(x) for x in zip(none, *(_unpacked(WORD, bits, 0, r["words"]) for r in sorted(built, key=lambda r: r["bucket"]) if r["kind"] == WORD)))
    shared = spark.sparkContext.broadcast((filters, words, counts))

    def run(batches):
        filters, words, counts = shared.value
        empty = segment(*none, hashes)
        for batch, texts in chunks(batches, text_col):
            h, before, ends = tokens(texts)
            uniq, back = np.unique(h, return_inverse=True)
            pairs, back2 = np.unique(pair_hashes(before, h, bits), return_inverse=True)
            f_word, f_pair = (middle(np.concatenate([probe(filters.get((kind, b), empty), x[i:j], hashes) for b, (i, j) in enumerate(zip(cut, cut[1:]))])) for kind, x in ((WORD, uniq), (PAIR, pairs)) for cut in [_cuts(x, bits)])
            at = np.minimum(np.searchsorted(words, uniq), max(0, len(words) - 1))
            exact = np.where(words[at] == uniq, counts[at], 0) if len(words) else np.zeros(len(uniq), np.int64)
            sums = _sums(ends, f_word[back], f_word[np.searchsorted(uniq, END)], f_pair[back2], exact[back], int(counts.sum()), len(words))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*cols, *map(pa.array, sums)], names=[*keep, *NAMES])

    return docs.mapInArrow(run, schema)


def lm_score(docs: DataFrame, trains: Column, text_col: str = "text", small: int = SMALL, hashes: int = HASHES) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, from a model of the texts of the rows where trains is true."""
    prepared(docs.sparkSession)
    size = F.coalesce(F.sum(F.octet_length(quoted(text_col).cast("string")) + 1), F.lit(0))
    total = docs.select(size).first()[0]
    keep = others(docs, *NAMES)
    marked = docs.select(*(quoted(c) for c in docs.columns), F.coalesce(trains, F.lit(False)).alias("__quire_trains"))
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + _RESULT)
    if total <= small:
        return _broadcast(marked, "__quire_trains", text_col, keep, schema, hashes)
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    bits = min(24, max(LEAST_BUCKET_BITS, (total // BUCKET_BYTES).bit_length()))
    own = [f.name for f in docs.schema.fields if f.name in keep or f.name == text_col]
    blk = F.pmod(F.xxhash64(*(quoted(c).cast("string") for c in own)), F.lit(blocks)).cast("int")
    dealt = marked.select(blk.alias("__quire_block"), "__quire_trains", *(quoted(c) for c in own))

    def parts_of(table: pa.Table) -> list[tuple]:
        texts = bytes_of(table.column(text_col).cast(pa.string()))
        flags = np.array(table.column("__quire_trains").to_pylist(), np.uint64)
        out, lo, size = [], 0, 0
        for hi in range(len(texts) + 1):
            n = len(texts[hi] or b"") if hi < len(texts) else 0
            if hi > lo and (hi == len(texts) or size + n > (1 << 20)):
                h, before, ends = tokens(texts[lo:hi])
                out.append((h, before, ends, np.repeat(flags[lo:hi], np.diff(np.concatenate([[0], ends])))))
                lo, size = hi, 0
            size += n
        return out

    def ask(table: pa.Table) -> pa.Table:
        kind, bucket, payload = zip(*_asked([(h, before, flag) for h, before, _, flag in parts_of(table)], bits))
        block = [table.column("__quire_block")[0].as_py()] * len(kind)
        return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        h, n, entry, cut = _merged(kind, bits, bucket, table.column("payload").to_pylist())
        q = probe(segment(h, n, hashes), h, hashes).astype(np.uint8)
        out = [q[entry[i:j]].tobytes() + (_small(n[entry[i:j]]) if kind == WORD else b"") for i, j in zip(cut, cut[1:])]
        size = [j - i for i, j in zip(cut, cut[1:])]
        rows = len(out)
        return pa.table({
            "block": table.column("block"), "kind": table.column("kind"), "bucket": table.column("bucket"), "n": pa.array(size, pa.int32()), "levels": pa.array(out, pa.binary()),
            "total": pa.array([int(n.sum())] * rows, pa.int64()), "distinct": pa.array([int((n > 0).sum())] * rows, pa.int64()),
        })

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        parts = parts_of(table)
        got = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        words = [r for r in got if r["kind"] == WORD]
        h = np.concatenate([p[0] for p in parts])
        uniq, back = np.unique(h, return_inverse=True)
        levels = [middle(np.concatenate([np.frombuffer(r["levels"], np.uint8, r["n"]) for r in got if r["kind"] == kind])) for kind in (WORD, PAIR)]
        exact = np.concatenate([_counts(r["levels"], r["n"], r["n"]) for r in words])[back]
        f_word, f_end = levels[WORD][back], levels[WORD][np.searchsorted(uniq, END)]
        _, back = np.unique(np.concatenate([pair_hashes(p[1], p[0], bits) for p in parts]), return_inverse=True)
        ends = np.concatenate([p[2] + at for p, at in zip(parts, np.cumsum([0] + [len(p[0]) for p in parts]))])
        sums = _sums(ends, f_word, f_end, levels[PAIR][back], exact, sum(r["total"] for r in words), sum(r["distinct"] for r in words))
        return pa.table({c: table.column(c) for c in keep} | dict(zip(NAMES, map(pa.array, sums))))

    asked = dealt.groupBy("__quire_block").applyInArrow(ask, _ASK)
    answers = asked.groupBy("kind", "bucket").applyInArrow(answer, "block int, kind int, bucket int, n int, levels binary, total long, distinct long")
    return dealt.groupBy("__quire_block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def op4_bloom_lm(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    rest = crc_rest(F.col("doc_id"), 7)
    return lm_score(docs.withColumn("held_out", rest == 2), rest != 2).select("doc_id", "held_out", *NAMES)
