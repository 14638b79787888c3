"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next stage's docs. All but the
last return the columns of documents, whatever their names: one that an operator also
makes is set aside while it works.

In every stage a null or empty text is a clean document without words, a null id is
an id of its own, rows that repeat are judged each (near_dedup and substring_dedup
never remove one of two rows with the same id because of the other), and an empty
table gives an empty table. Ties are broken by the smaller id. Texts are whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontamination, near_dedup, substring_dedup, toxicity
from quire.llm.common import crc_rest, docs_of, quoted, remove, shared_dir, written


def kept_columns(docs: DataFrame, made: tuple[str, ...], work: Callable[[DataFrame], DataFrame], **new) -> DataFrame:
    """work(docs) with the columns of docs; those named like one that work makes, or with a dot, wait under another name. new: columns of docs from work's, unless docs lacks them."""
    aside = {c: f"__quire_{i}" for i, c in enumerate(docs.columns) if c.lower() in made or "." in c}
    out = work(docs.select(*(quoted(c).alias(aside.get(c, c)) for c in docs.columns)))
    return out.select(*(new.get(c.lower(), lambda x: x)(quoted(aside.get(c, c))).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go."""
    labels = docs_of(spark, sf_dir, "labels").where(crc_rest(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    return kept_columns(docs, ("score", "predicted"), lambda d: toxicity.toxicity(d, model).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 over five-word shingles, the document of the smallest id stays."""
    gone = near_dedup.near_dedup(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(quoted(c) for c in docs.columns))


def strike_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that start in a document of a smaller id go; texts without any stay as they are, and documents that lose all their words go. n_chars, if there, follows the text."""
    struck = F.col("n_removed") > 0
    return kept_columns(
        docs,
        ("n_words", "n_removed", "kept_text"),
        lambda d: substring_dedup.substring_dedup(d).where("n_removed = 0 OR n_removed < n_words"),
        text=lambda c: F.when(struck, F.col("kept_text")).otherwise(c),
        n_chars=lambda c: F.when(struck, F.length("kept_text").cast("long")).otherwise(c),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a ten-word window with a benchmark item go."""
    items = docs_of(spark, sf_dir, "benchmark")
    return kept_columns(docs, ("n_words", "n_hit", "items", "hit_spans", "contaminated"), lambda d: decontamination.decontaminate(d, items).where("NOT contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids (little-endian unsigned 32-bit integers) of each document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", strike_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL cannot express the trained classifier of the first stage nor BPE. The tests hold the operators against brute force and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables of the stages before are deleted once read."""
    where = shared_dir(spark)
    docs, before = docs_of(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{where}/{i}_{name}")
        if before:
            remove(spark, before)
        before = f"{where}/{i}_{name}"
    return docs
