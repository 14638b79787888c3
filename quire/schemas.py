"""Table schemas. Coordinates are points on one tall page a document, y downwards."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()

RECT = T.StructType([T.StructField(n, _D) for n in ("top", "left", "bottom", "right")])
RGB = T.StructType([T.StructField(n, _D) for n in ("r", "g", "b")])
CHAR = T.StructType([T.StructField("ch", T.StringType()), T.StructField("bbox", RECT)])

DOC = T.StructField("doc_id", T.StringType())
PAGE = T.StructField("page_index", T.IntegerType())

BLOCKS = T.StructType([DOC, T.StructField("block_id", T.LongType()), PAGE, T.StructField("text", T.StringType()), T.StructField("bbox", RECT), T.StructField("chars", T.ArrayType(CHAR))])
