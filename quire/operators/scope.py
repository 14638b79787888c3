"""Scoping: the blocks of a region, with common line heights and merged neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rect as R
from quire.functions.tokens import is_date_token, is_numeric_token

from .pages import block_rows, fold, geometry, group_lists, is_pages, line_heights, page_rows
from .search import search


@dataclass(frozen=True)
class MergeRules:
    """Pairs that are never merged directly."""

    no_numeric_pair_merge: bool = False
    no_date_pair_merge: bool = False


def _renumbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered by page, top, left and right inside their document."""
    b = F.col("bbox")
    w = Window.partitionBy("doc_id").orderBy("page_index", b["top"], b["left"], b["right"], "block_id")
    return blocks.withColumn("block_id", (F.row_number().over(w) - 1).cast("long"))


_HEIGHTS = T.ArrayType(T.StructType([T.StructField("top", T.DoubleType()), T.StructField("bottom", T.DoubleType())]))


def _more(blocks: DataFrame) -> list[str]:
    """The columns of rows beside those of a block."""
    return [] if is_pages(blocks) else [c for c in blocks.columns if c not in ("doc_id", "page_index", "block_id", "text", "bbox")]


def _normalized_pages(pages: DataFrame, more: list[str]) -> DataFrame:
    pages = pages.withColumn("__even", fold(_HEIGHTS, line_heights)(geometry(pages)))
    item = lambda b, e: F.struct(b["block_id"].alias("block_id"), b["text"].alias("text"), b["left"].alias("left"), e["top"].alias("top"), b["right"].alias("right"), e["bottom"].alias("bottom"), *(b[c].alias(c) for c in more))
    return pages.select("doc_id", "page_index", F.zip_with("blocks", "__even", item).alias("blocks"))


def normalize_lines(blocks: DataFrame) -> DataFrame:
    """Blocks (as rows, or pages) as rows with the mean top and bottom of their line; characters stay as they are."""
    more = _more(blocks)
    out = block_rows(_normalized_pages(page_rows(blocks, *more), more), None, *more)
    return out if is_pages(blocks) else out.select(*blocks.columns)


def merge_blocks(blocks: DataFrame, threshold: float, rules: MergeRules = MergeRules()) -> DataFrame:
    """Neighbours on a line at most threshold apart become one block: texts by left, top and place, joined by spaces; characters in the same order; the union of the rectangles. The edges' pairs are judged by the rules, but groups may meet through a third block. Of blocks as rows or as pages; the answer is rows."""
    if threshold <= 0:
        return block_rows(blocks) if is_pages(blocks) else blocks
    has_chars = "chars" in blocks.columns
    pages = page_rows(blocks, *(["chars"] if has_chars else []))
    pair = (rules.no_numeric_pair_merge, rules.no_date_pair_merge)
    tests = {"numeric": is_numeric_token, "date": is_date_token}
    kinds = {n: lambda b, f=f: f(b["text"]) for rule, (n, f) in zip(pair, tests.items()) if rule}
    places = fold(T.ArrayType(T.ArrayType(T.IntegerType())), lambda pages: group_lists(pages, threshold, pair))
    pages = pages.withColumn("__groups", places(geometry(pages, **kinds)))
    # each group's blocks are put together before groups become rows, so that no row carries a page
    whole = F.transform("__groups", lambda g: F.transform(g, lambda i: F.get("blocks", i)))
    one = pages.select("doc_id", "page_index", F.explode(whole).alias("x"))
    alone, first = F.size("x") == 1, F.get("x", F.lit(0))
    of = lambda n, f: F.when(alone, first[n]).otherwise(f(F.transform("x", lambda b: b[n])))
    box = R.rect(of("top", F.array_min), of("left", F.array_min), of("bottom", F.array_max), of("right", F.array_max))
    text = F.when(alone, F.coalesce(first["text"], F.lit(""))).otherwise(F.array_join(F.transform("x", lambda b: b["text"]), " "))
    chars = [F.flatten(F.transform("x", lambda b: b["chars"])).alias("chars")] if has_chars else []
    return one.select("doc_id", of("block_id", F.array_min).alias("block_id"), "page_index", text.alias("text"), box.alias("bbox"), *chars)


def scoped(blocks: DataFrame, region: R.Rectangle, overlap: float = 0.0, merge_threshold: float = 0.0, normalize: bool = False, rules: MergeRules = MergeRules()) -> DataFrame:
    """The blocks (rows, or pages) of a region, then with common line heights, then merged; numbered anew where their order may change. The answer is rows."""
    out = search(blocks, region, overlap)
    if normalize:
        out = _renumbered(normalize_lines(out))
    if merge_threshold > 0:
        out = _renumbered(merge_blocks(out, merge_threshold, rules))
    return block_rows(out) if is_pages(out) else out
