"""Reading order, page bodies and document text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.regex import CLOSE, OPEN

from .pages import Pages, fold, geometry, line_order, lists, page_rows

_ORDER = T.ArrayType(T.ArrayType(T.IntegerType()))


def _order(pages: Pages) -> pa.Array:
    """The places of the blocks of each line."""
    order, begins = line_order(pages)
    return lists(pages.of_page(pages.page[order][begins]), lists(np.append(begins, len(order)), pages.places(order)))


def ordered_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, blocks, lines): lines holds the places of blocks, in reading order."""
    pages = page_rows(blocks)
    return pages.withColumn("lines", fold(_ORDER, _order)(geometry(pages))).select("doc_id", "page_index", "blocks", "lines")


def lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_no, block_ids)."""
    ids = F.transform("lines", lambda line: F.transform(line, lambda i: F.get("blocks", i)["block_id"]))
    return ordered_pages(blocks).select("doc_id", "page_index", F.posexplode(ids).alias("line_no", "block_ids"))


def plain(text: Column) -> Column:
    """A block's text as it is in bodies: not null, and free of the marks around matches."""
    marked = text.contains(OPEN) | text.contains(CLOSE)
    return F.when(marked, F.translate(text, OPEN + CLOSE, "")).otherwise(F.coalesce(text, F.lit("")))


def body_of(blocks: str = "blocks", lines: str = "lines") -> Column:
    """The body of a page of ordered_pages: blocks joined by spaces, lines by line breaks."""
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line, lambda i: plain(F.get(blocks, i)["text"])), " ")), "\n")


def bodies(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, body)."""
    return ordered_pages(blocks).select("doc_id", "page_index", body_of().alias("body"))


def text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): every page's body and a line break, pages in order; pages without blocks are absent."""
    per_page = F.sort_array(F.collect_list(F.struct("page_index", "body")))
    joined = F.array_join(F.transform("p", lambda x: F.concat(x["body"], F.lit("\n"))), "")
    return bodies(blocks).groupBy("doc_id").agg(per_page.alias("p")).select("doc_id", joined.alias("text"))
