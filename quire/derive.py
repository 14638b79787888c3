"""Layouts derived from the star-schema tables, so that SQL can state every expected result."""

from __future__ import annotations

from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rect as R
from quire.operators.pages import PAGE_BLOCKS, block_rows, bounded, lists

PAGE_HEIGHT, PAGE_WIDTH = 792, 612


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key where their files have fewer splits than there are cores, as a file of one row group does; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(2 * cores, key)


#: Words of a page (fixed values).
PAGE_WORDS = 300


def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document in 10-point Courier: six to a line, fifty lines to a page. A word of over 14 characters is set narrower, in the width of 14. One row a page: (doc_id, page_index, blocks), as of operators.pages."""
    bounded(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("page_index", T.IntegerType()), T.StructField("blocks", PAGE_BLOCKS)])
    return docs.mapInArrow(lambda batches: map(_pages_of_texts, batches), schema)


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[ord(c) for c in ascii_letters + digits]] = True


def _pages_of_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """word_pages of a batch of (doc_id, text)."""
    texts = batch.column(1).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = _WORD_BYTE[raw]
    # a word begins where no letter of the same text comes before
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = at[:-1][np.diff(at) > 0]
    first[edges] = letter[edges]
    begin = np.flatnonzero(first)
    size = np.add.reduceat(letter, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    n = np.diff(np.searchsorted(begin, at))  # words of each text
    pos = np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
    page, i = np.divmod(pos, PAGE_WORDS)
    base = page * PAGE_HEIGHT + 36 + i // 6 * 14
    left = (36 + i % 6 * 96).astype(float)
    text = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(raw[letter]))
    cols = {"block_id": pos, "text": text, "left": left, "top": base - 6.29, "right": left + np.minimum(size, 14) * 6.0, "bottom": base + 1.57}
    starts = np.flatnonzero(i == 0)
    doc = np.repeat(np.arange(len(n)), n)[starts]
    blocks = lists(np.append(starts, len(begin)), pa.StructArray.from_arrays([pa.array(x) for x in cols.values()], names=list(cols)))
    return pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(page[starts].astype(np.int32)), blocks], names=["doc_id", "page_index", "blocks"])


def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of word_pages as rows."""
    return block_rows(word_pages(spark, sf_dir))


def advance(text: Column, bbox: Column) -> Column:
    """The width of each character of a word."""
    return (bbox["right"] - bbox["left"]) / F.length(text)


WORDS_SQL = """w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM documents)),
blocks AS (SELECT doc_id, pos AS block_id, CAST(pos // 300 AS INTEGER) AS page_index, CAST(pos // 6 AS INTEGER) AS line, w AS text,
  CAST(792 * (pos // 300) + 36 + (pos // 6) % 50 * 14 AS DOUBLE) - 6.29::DOUBLE AS top, CAST(36 + pos % 6 * 96 AS DOUBLE) AS "left",
  CAST(792 * (pos // 300) + 36 + (pos // 6) % 50 * 14 AS DOUBLE) + 1.57::DOUBLE AS bottom, CAST(36 + pos % 6 * 96 + 6 * length(substr(w, 1, 14)) AS DOUBLE) AS "right" FROM w)"""


def line_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole-numbered rectangles a line item: a as a block on a page, b as another."""
    li = table(spark, sf_dir, "lineitem")
    left, top = F.col("l_partkey") % 500, F.col("l_orderkey") % 700
    left2, top2 = F.col("l_suppkey") * 7 % 500, F.col("l_partkey") % 700
    return li.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), (F.col("l_suppkey") % 10).cast("int").alias("page_index"),
        R.rect(top, left, top + F.col("l_linenumber") * 2, left + F.col("l_quantity")).alias("a"),
        R.rect(top2 + 25, left2, top2, left2 + 40).alias("b"),
    )


#: The same; b has its top and bottom exchanged, so it is not normalised: (bt, bb) are its raw sides, (b1, b2) its normalised ones.
RECTS_SQL = """r AS (SELECT l_orderkey AS k1, l_linenumber AS k2, CAST(l_suppkey % 10 AS INTEGER) AS page_index,
  CAST(l_orderkey % 700 AS DOUBLE) AS ay, CAST(l_partkey % 500 AS DOUBLE) AS al, CAST(l_orderkey % 700 + l_linenumber * 2 AS DOUBLE) AS ab, l_partkey % 500 + l_quantity AS ar,
  CAST(l_partkey % 700 + 25 AS DOUBLE) AS bt, CAST(l_suppkey * 7 % 500 AS DOUBLE) AS bl, CAST(l_partkey % 700 AS DOUBLE) AS bb, CAST(l_suppkey * 7 % 500 + 40 AS DOUBLE) AS br FROM lineitem),
n AS (SELECT *, greatest(least(ar, br) - greatest(al, bl), 0) AS sx, least(ar, br) - greatest(al, bl) AS gx,
  greatest(least(ab, bt) - greatest(ay, bb), 0) AS sy, least(ab, bt) - greatest(ay, bb) AS gy, (ar - al) * (ab - ay) AS area FROM r)"""
