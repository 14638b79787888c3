"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams of letters (a space marks a word's edge), hashed to 2**16
buckets, are gathered from a bounded sample of labelled documents: SAMPLE of each language in
expectation, or all it has, chosen by a hash of the id. Priors are counted over all
labelled documents. The matrix of
log probabilities (2**16 rows, one column a language) is broadcast; whole texts are
scored in numpy by summing its rows. The score is the posterior of the best language.

Null texts and texts without a letter are "und" with score 0; so is everything if
nothing is labelled. Ties go to the first language by name. Input columns named like
an output column are replaced by it. No document is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .char_ngrams import Chars
from .common import crc_rest, docs_of, others, prepared, quoted
from .words import chunks

BITS = 16
LONGEST = 3
SAMPLE = 20_000
SMOOTHING = 0.5


def _counter(batches):
    """Per task and language: documents, and the count of each bucket."""
    total: dict[str, np.ndarray] = {}
    for batch, texts in chunks(batches, "text"):
        langs = np.array(batch.column(1).to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            got = total.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            got[-1] += len(rows)
            for _, _, bucket in Chars([texts[i] for i in rows.tolist()]).ngrams(LONGEST, BITS):
                got[:-1] += np.bincount(bucket, minlength=1 << BITS)
    for lang, got in total.items():
        used = np.flatnonzero(got)
        yield pa.record_batch([pa.array([lang]), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([got[used].tolist()], pa.list_(pa.int64()))], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities by language and bucket) from rows with a language."""
    prepared(labelled.sparkSession)
    rows = labelled.where(quoted(lang_col).isNotNull()).select(quoted(id_col).cast("string").alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"))
    there = dict(rows.groupBy("lang").count().collect())
    limit = F.lit(1 << 30)
    for lang, n in there.items():
        if n > sample:
            limit = F.when(F.col("lang") == lang, int(sample / n * (1 << 30))).otherwise(limit)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limit)
    found = (
        some.select("text", "lang")
        .mapInArrow(_counter, "lang string, bucket array<int>, n array<long>")
        .select("lang", F.explode(F.arrays_zip("bucket", "n")).alias("b"))
        .groupBy("lang", "b.bucket")
        .agg(F.sum("b.n").alias("n"))
        .toArrow()
    )
    names = sorted(set(found.column(0).to_pylist()))
    counts = np.zeros((len(names), (1 << BITS) + 1))
    which = {x: i for i, x in enumerate(names)}
    counts[[which[x] for x in found.column(0).to_pylist()], found.column(1).to_numpy()] = found.column(2).to_numpy()
    smooth = counts[:, :-1] + SMOOTHING
    prior = np.array([there[x] for x in names], float) / max(1, sum(there.values()))
    return names, np.log(np.maximum(prior, 1e-300)), np.log(smooth / smooth.sum(axis=1, keepdims=True))


def predict(texts: list[bytes | None], names: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    chars = Chars(texts)
    total = np.tile(prior, (len(texts), 1))
    for _, at, bucket in chars.ngrams(LONGEST, BITS):
        for i in range(len(names)):
            total[:, i] += chars.sums(at, logs[i][bucket])
    letters = chars.sums(np.flatnonzero(chars.inside), np.ones(int(chars.inside.sum()))) > 0
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    with np.errstate(under="ignore"):
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())], np.where(letters, score, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    keep = others(docs, "lang_pred", "score")
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch, texts in chunks(batches, text_col):
            lang, score = predict(texts, *shared.value)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*cols, pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text", "lang")
    rest: Column = crc_rest(F.col("doc_id"), 5)
    model = train(docs.where(rest != 0))
    return identify(docs.select("doc_id", "text", (rest == 0).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
