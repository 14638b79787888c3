"""PDF files as tables.

A document is parsed once, in one pass of the Python workers, to one row a page with
the page's box and its characters; pages, characters, blocks and errors are plans over
that table. A damaged file has no pages; only encryption that cannot be opened is an
error, which becomes a row of errors instead of failing the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rect as R
from quire.operators import layout, segment
from quire.operators.pages import arrow_type
from quire.schemas import RGB

from .pdf.extract import MalformedEncryption, PasswordError, UnsupportedEncryption, extract

_GLYPH = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ch", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("left", "top", "right", "bottom")),
    T.StructField("font_size", T.DoubleType()), T.StructField("fill_rgb", RGB), T.StructField("font_name", T.StringType()),
])
_PAGE = [T.StructField("page_index", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("x_min", "y_min", "width", "height")), T.StructField("rotation", T.IntegerType())]
_REST = [T.StructField("glyphs", T.ArrayType(_GLYPH)), T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())]
CONCURRENCY = ("on", "off", "auto")


def check_concurrency(mode: str) -> str:
    """Spark decides on parallelism; the argument is only validated."""
    plain = mode.strip().lower()
    if plain not in CONCURRENCY:
        raise ValueError(f"unknown concurrency {mode!r}: {' | '.join(CONCURRENCY)}")
    return plain


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the files that a path or glob names, in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def parse_pdfs(documents: DataFrame, password: str | bytes | None = None) -> DataFrame:
    """One row a page of documents (doc_id, content[, password]): the page's box, its visible characters in page space, or the document's error."""
    if isinstance(password, str):
        password = password.encode()
    own = "password" in documents.columns
    doc = documents.schema["doc_id"]
    schema = T.StructType([doc, *_PAGE, *_REST])
    source = documents.select("doc_id", F.col("content").cast("binary").alias("content"), *([F.col("password").cast("binary").alias("password")] if own else []))
    arrow = {f.name: arrow_type(f.dataType) for f in schema.fields}

    def one(doc_id: pa.Array, content, secret) -> pa.RecordBatch:
        """The rows of one document."""
        try:
            pages, glyphs = extract(content or b"", secret)
        except (PasswordError, MalformedEncryption, UnsupportedEncryption) as e:
            error = {"doc_id": doc_id, "kind": pa.array([type(e).__name__]), "message": pa.array([str(e)])}
            return pa.record_batch([error.get(n, pa.nulls(1, k)) for n, k in arrow.items()], names=list(arrow))
        made = dict(zip((f.name for f in _PAGE), zip(*pages))) if pages else {}
        # glyphs come page by page
        index, *fields = zip(*glyphs) if glyphs else [()] * 10
        cut = pa.array(np.searchsorted(np.array(index, np.int64), [*made.get("page_index", ()), len(pages)]), pa.int32())
        rgb = fields.pop(7)
        kinds = {f.name: f.type for f in arrow["glyphs"].value_type}
        colour = pa.StructArray.from_arrays([pa.array([c and c[i] for c in rgb], pa.float64()) for i in range(3)], names=list("rgb"), mask=pa.array([c is None for c in rgb], pa.bool_()))
        arrays = {n: pa.array(v, kinds[n]) for n, v in zip((n for n in kinds if n != "fill_rgb"), fields)} | {"fill_rgb": colour}
        cols = {"doc_id": pa.concat_arrays([doc_id] * len(pages)) if pages else doc_id[:0], "glyphs": pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([arrays[n] for n in kinds], names=list(kinds)))}
        cols |= {n: pa.array(v, arrow[n]) for n, v in made.items()}
        return pa.record_batch([cols[n].cast(k) if n in cols else pa.nulls(len(pages), k) for n, k in arrow.items()], names=list(arrow))

    def run(batches):
        for batch in batches:
            secrets = batch.column(2).to_pylist() if own else [None] * batch.num_rows
            for i in range(batch.num_rows):  # a batch a document: its size is that of one document's characters
                yield one(batch.column(0).slice(i, 1), batch.column(1)[i].as_py(), secrets[i] if secrets[i] is not None else password)

    return source.mapInArrow(run, schema)


def pages_of(parsed: DataFrame) -> DataFrame:
    return layout.stack_pages(parsed.where("page_index IS NOT NULL").select("doc_id", *(f.name for f in _PAGE)))


def glyphs_of(parsed: DataFrame) -> DataFrame:
    """Characters in painting order, in page space, y upwards."""
    g = parsed.select("doc_id", "page_index", F.explode("glyphs").alias("g"))
    return g.select("doc_id", "page_index", "g.seq", "g.ch", R.rect(*(F.col("g")[n] for n in R.SIDES)).alias("bbox"), "g.font_size", "g.fill_rgb", "g.font_name")


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind IS NOT NULL").select("doc_id", "kind", "message")


def chars_of(parsed: DataFrame, style: bool = False) -> DataFrame:
    """Visible characters on the tall page, each place painted once; with font size, colour and font if style."""
    columns = ["doc_id", "page_index", "seq", "ch", "bbox", *(["font_size", "fill_rgb", "font_name"] if style else [])]
    return layout.dedupe_chars(layout.canonicalize(glyphs_of(parsed).select(*columns), pages_of(parsed)))


def blocks_of(parsed: DataFrame, keep_chars: bool = True) -> DataFrame:
    """Word-level blocks on the tall page, each painted once."""
    item = lambda g: F.struct(g["ch"].alias("ch"), R.rect(*(g[n] for n in R.SIDES)).alias("bbox"), g["font_size"].alias("font_size"))
    raw = segment.segment_pages(parsed.where("glyphs IS NOT NULL").select("doc_id", "page_index", F.transform("glyphs", item).alias("glyphs")), keep_chars)
    pages = pages_of(parsed)
    placed = layout.canonicalize(raw, pages)
    if keep_chars:
        p = pages.select("doc_id", "page_index", F.struct("x_min", "y_min", "width", "height", "rotation", "rotated_width", "rotated_height", "y_offset").alias("__page"))
        move = F.transform("chars", lambda c: F.struct(c["ch"].alias("ch"), layout.canonical_rect(c["bbox"], F.col("__page")).alias("bbox")))
        seen = F.filter(move, lambda c: (c["bbox"]["left"] < c["bbox"]["right"]) & (c["bbox"]["top"] < c["bbox"]["bottom"]))
        placed = placed.join(p, ["doc_id", "page_index"]).withColumn("chars", seen).drop("__page")
    return layout.dedupe_blocks(placed)
