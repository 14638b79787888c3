"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its distinct words and their character 3- to 6-grams (a space
marks a word's edge), hashed to 2**20 buckets. Bucket embeddings and the softmax over
their average are trained jointly, in numpy in one task, by Adagrad over minibatches of a
bounded sample of labelled rows: SAMPLE of label 0 and of label 1 in expectation,
chosen by a hash of the id; the bias is corrected for their different shares. Buckets
that training leaves out are counted and dropped before, so that the task holds only
the others. Misspellings and new endings share n-grams with words seen in training.

A bucket enters the two logits only through its embedding times the softmax weights,
so one number a bucket is broadcast (8 MB), and whole texts are scored by its mean.

A null or empty text has an empty bag and scores the bias alone. Without labels of
both classes every text scores the share of label 1 (0 if there are none). An id
labelled twice counts by its larger label; each document of a repeated id is a
training row. Input columns named like an output column are replaced by it.
Documents are not shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .char_ngrams import Chars
from .common import crc_rest, docs_of, others, prepared, quoted, remove, shared_dir, written
from .words import chunks, mix, span_hashes, trim

BITS = 20
LONGEST = 6
WIDTH = 4
LEAST_TEXTS = 8
MOST_TEXTS = 0.2
SAMPLE = (4500, 2500)
EPOCHS = 12
BATCH = 64
RATE = 0.3
EMBEDDING_RATE = 30.0


def _features(chars: Chars):
    """(start, bucket) of each n-gram of 3 to 5 characters, then of each word, over the distinct words of each text."""
    edge = np.diff(chars.inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = span_hashes(chars.cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), starts, ends, 0)
    doc = np.searchsorted(chars.base, starts, side="right")
    _, first = np.unique(mix(h + doc.astype(np.uint64)), return_index=True)
    first.sort()
    starts, ends, h = starts[first], ends[first], h[first]
    step = np.zeros(len(chars.cp), np.int8)
    step[starts], step[ends] = 1, -1
    chars.inside = np.cumsum(step, dtype=np.int8).astype(bool)
    chars.cp = np.where(chars.inside, chars.cp, np.uint32(32))
    for n, at, bucket in chars.ngrams(LONGEST, BITS):
        if n >= 3:
            yield at, bucket
    yield starts, (h >> np.uint64(64 - BITS)).astype(np.int32)


def _bags(batches):
    """Label and bag of each text: its distinct buckets, then their counts, as 32-bit integers."""
    for batch, texts in chunks(batches, "text"):
        chars = Chars(texts, digits=True)
        doc, bucket = [], []
        for at, b in _features(chars):
            doc.append(np.searchsorted(chars.base, at, side="right") - 1)
            bucket.append(b)
        key = (np.concatenate(doc).astype(np.int64) << BITS) | np.concatenate(bucket)
        key, n = np.unique(key, return_counts=True)
        cut = np.searchsorted(key >> BITS, np.arange(len(texts) + 1)).tolist()
        bucket, n = (key & ((1 << BITS) - 1)).astype("<i4"), n.astype("<i4")
        bags = [bucket[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(cut, cut[1:])]
        yield pa.record_batch([batch.column(1), pa.array(bags, pa.binary())], names=["label", "bag"])


def _parts(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = len(bag) // 8
    return np.frombuffer(bag, "<i4", m), np.frombuffer(bag, "<i4", m, 4 * m)


def _texts(batches):
    """Texts, and texts of label 0, that hold each bucket."""
    both = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for y, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            both[y, _parts(bag)[0]] += 1  # a text holds a bucket once
    held = np.flatnonzero(both.any(axis=0))
    for lo in range(0, len(held), 1 << 16):
        some = held[lo : lo + (1 << 16)]
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(both[:, some].sum(axis=0).astype(np.int64)), pa.array(both[0, some].astype(np.int64))], names=["bucket", "n", "plain"])


def _thinned(shared):
    """Label, crc32 and length of each bag, and the part of it in used buckets."""

    def run(batches):
        used = np.zeros(1 << BITS, bool)
        used[shared.value] = True
        for batch in batches:
            bags = batch.column(1).to_pylist()
            out, size = [], []
            for bag in bags:
                bucket, n = _parts(bag)
                on = used[bucket]
                out.append(bucket[on].tobytes() + n[on].tobytes())
                size.append(int(n.sum(dtype=np.int64)))
            yield pa.record_batch([batch.column(0), pa.array([zlib.crc32(x) for x in bags], pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["label", "crc", "size", "bag"])

    return run


def gradients(e: np.ndarray, w: np.ndarray, b: np.ndarray, f: np.ndarray, weight: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple:
    """The mean cross-entropy of some rows with labels y, and its gradients by embeddings e, softmax weights w and biases b. Row row[i] holds bucket f[i] with weight[i]."""
    mean = np.stack([np.bincount(row, weight * x[f], len(y)) for x in e], axis=1)
    logit = mean @ w + b
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(p[np.arange(len(y)), y]).mean()
    p[np.arange(len(y)), y] -= 1.0
    p /= len(y)
    back = p @ w.T
    return loss, [np.bincount(f, weight * back[row, d], e.shape[1]) for d in range(len(e))], mean.T @ p, p.sum(axis=0)


def fit(labels: np.ndarray, cut: np.ndarray, bucket: np.ndarray, n: np.ndarray, seed: int = 0, size: list[int] | None = None) -> tuple[np.ndarray, float]:
    """(the part of each bucket in logit 1 minus logit 0, the bias) of the trained network. Row i holds bucket[cut[i]:cut[i + 1]], each n times; bucket is overwritten; size: the lengths of the rows where some buckets are left out."""
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if share in (0.0, 1.0):
        return np.zeros(1 << BITS), bias
    rng = np.random.default_rng(seed)
    size = [max(1, x) for x in size or [int(n[i:j].sum(dtype=np.int64)) for i, j in zip(cut, cut[1:])]]
    # buckets in too few texts to learn from, or in too many of label 0 to tell anything, are left out; the others weigh by rarity
    df, plain = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for i, y in enumerate(labels.tolist()):  # a text holds a bucket once
        df[bucket[cut[i] : cut[i + 1]]] += 1
        if not y:
            plain[bucket[cut[i] : cut[i + 1]]] += 1
    used = (df >= LEAST_TEXTS) & (plain <= MOST_TEXTS * (labels == 0).sum())
    rarity = np.where(used, np.log(len(labels) / np.maximum(df, 1)), 0.0)
    weight, ends = np.empty(len(bucket), np.float32), [0]
    number = np.cumsum(used, dtype=np.int32) - 1  # without gaps from here on
    for i, j, long in zip(cut.tolist(), cut[1:].tolist(), size):
        f, at = bucket[i:j], ends[-1]
        on = used[f]
        f = f[on]
        weight[at : at + len(f)] = n[i:j][on] * rarity[f] / long
        bucket[at : at + len(f)] = number[f]  # in place: never ahead of what is read
        ends.append(at + len(f))
    bucket, weight, cut = bucket[: ends[-1]], weight[: ends[-1]], np.array(ends)
    del n
    e = np.zeros((WIDTH, int(used.sum())))
    w, b = rng.normal(0, 0.5, (WIDTH, 2)), np.array([0.0, bias])
    ge, gw, gb = 1e-8, np.full((WIDTH, 2), 1e-6), np.full(2, 1e-2)
    steps, step = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            long = cut[rows + 1] - cut[rows]
            place = np.repeat(cut[rows] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            row = np.repeat(np.arange(len(rows)), long)
            f, share_ = bucket[place], weight[place]
            _, de, dw, db = gradients(e, w, b, f, share_, row, labels[rows])
            # one Adagrad scale for all embeddings: rates of their own would let rare buckets learn single texts by heart
            left = 1 - step / steps
            step += 1
            ge += sum(float(x @ x) for x in de)
            for d in range(WIDTH):
                e[d] -= EMBEDDING_RATE * left / np.sqrt(ge) * de[d]
            gw += dw * dw
            w -= RATE * left * dw / np.sqrt(gw)
            gb += db * db
            b -= 0.1 * RATE * left * db / np.sqrt(gb)
    part = np.zeros(1 << BITS)
    part[used] = rarity[used] * ((w[:, 1] - w[:, 0]) @ e)
    return part, float(b[1] - b[0])


def _fit(batches):
    """The model of all rows (label, crc, size, bag) as one row."""
    # tasks may end in any order; training must not depend on it
    rows = deque(sorted((row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 2)))), key=lambda x: x[:3]))
    if not rows:
        return
    label, size = np.array([x[0] for x in rows]), [x[3] for x in rows]
    cut = np.concatenate([[0], np.cumsum([len(x[2]) // 8 for x in rows])])
    bucket, n = np.empty(cut[-1], np.int32), np.empty(cut[-1], np.int32)
    for i, j in zip(cut.tolist(), cut[1:].tolist()):
        bucket[i:j], n[i:j] = _parts(rows.popleft()[2])
    del rows
    trim()
    part, bias = fit(label, cut, bucket, n, size=size)
    yield pa.record_batch([pa.array([part.tobytes()], pa.binary()), pa.array([bias])], names=["part", "bias"])


def score(texts: list[bytes | None], part: np.ndarray, bias: float) -> np.ndarray:
    chars = Chars(texts, digits=True)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for at, bucket in _features(chars):
        total += chars.sums(at, part[bucket])
        n += chars.counts(at)
    return 1.0 / (1.0 + np.exp(-np.clip(bias + total / np.maximum(n, 1.0), -700, 700)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from the labels (0 or 1) of documents; the labels are joined by id after sampling."""
    prepared(docs.sparkSession)
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    there = dict(known.groupBy("label").count().collect())
    shares = [min(1.0, most / max(1, there.get(k, 0))) for k, most in enumerate(sample)]
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    known = known.where(place < F.when(F.col("label") == 1, int(shares[1] * (1 << 30))).otherwise(int(shares[0] * (1 << 30))))
    # the sample's (id, label) rows: the side to broadcast
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "label", "id")
    where = shared_dir(docs.sparkSession)
    bags = written(texts.mapInArrow(_bags, "label int, bag binary"), where)
    plain = bags.where("label = 0").count()
    used = bags.mapInArrow(_texts, "bucket int, n long, plain long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))
    used = used.where((F.col("n") >= LEAST_TEXTS) & (F.col("plain") <= MOST_TEXTS * plain)).select("bucket").toArrow().column(0).to_numpy()
    thinned = _thinned(docs.sparkSession.sparkContext.broadcast(used))
    rows = bags.mapInArrow(thinned, "label int, crc long, size long, bag binary").repartition(1)  # the sample is bounded
    fitted = rows.mapInArrow(_fit, "part binary, bias double").toArrow().to_pylist()
    remove(docs.sparkSession, where)
    if not fitted:
        return np.zeros(1 << BITS), -700.0
    return np.frombuffer(fitted[0]["part"]), fitted[0]["bias"] - float(np.log(shares[1] / shares[0]))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    keep = others(docs, "score", "predicted")
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch, texts in chunks(batches, text_col):
            s = score(texts, *shared.value)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*cols, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def fitted(spark, sf_dir: str) -> tuple[np.ndarray, float]:
    """The model of the queries: learned from rows whose crc32(doc_id) is not divisible by 5."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    return train(docs, docs_of(spark, sf_dir, "labels").where(crc_rest(F.col("doc_id"), 5) != 0))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text", (crc_rest(F.col("doc_id"), 5) == 0).alias("held_out"))
    return toxicity(docs, fitted(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
