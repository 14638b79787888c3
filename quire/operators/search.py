"""Rectangle and regular-expression search over blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rect as R
from quire.functions.regex import CLOSE, OPEN, java

from .pages import is_pages, lists
from .reading import bodies, body_of, ordered_pages, plain

#: The least share of a block that counts, so touching never does (a fixed value).
LEAST_SHARE = 1e-5
CELL, MOST_CELLS, FARTHEST = 72.0, 4096, 1e15


def clamped_share(overlap: float) -> float:
    return max(min(max(overlap, 0.0), 1.0), LEAST_SHARE)


def hits(block: Column, query: Column, overlap: float) -> Column:
    """Whether at least that share of the block's area lies inside the query rectangle; never where a side of the block is not a finite number, or one of the query no number."""
    known = F.lit(True)
    for n in R.SIDES:
        known = known & query[n].isNotNull() & ~F.isnan(query[n])
    return R.is_finite(block) & known & R.intersects(block, query) & (R.area(block) > 0) & (R.intersection_area(block, query) >= R.area(block) * clamped_share(overlap))


def hits_one(block: Column, query: R.Rectangle, overlap: float) -> Column:
    """hits for one known rectangle: blocks that lie wholly outside or inside are told by their sides alone."""
    q = query.normalized()
    left, top, right, bottom = (block[n] for n in ("left", "top", "right", "bottom"))
    full = hits(block, q.literal(), overlap)
    if any(math.isnan(v) for v in (q.left, q.top, q.right, q.bottom)):
        return full
    out = ((bottom < q.top) & (top < q.top)) | ((top > q.bottom) & (bottom > q.bottom)) | ((right < q.left) & (left < q.left)) | ((left > q.right) & (right > q.right))
    inside = (top >= q.top) & (bottom <= q.bottom) & (left >= q.left) & (right <= q.right) & (top > float("-inf")) & (bottom < float("inf")) & (left > float("-inf")) & (right < float("inf"))
    inside = inside & (top < bottom) & (left < right) & ((right - left) * (bottom - top) > 0)
    return F.when(out, False).when(inside, True).otherwise(full)


def search(blocks: DataFrame, query: R.Rectangle, overlap: float = 0.0) -> DataFrame:
    """The blocks that one rectangle hits, as rows or pages as they came: a filter, which folds into the scan's stage."""
    if is_pages(blocks):
        return blocks.withColumn("blocks", F.filter("blocks", lambda b: hits_one(b, query, overlap)))
    return blocks.where(hits(F.col("bbox"), query.normalized().literal(), overlap))


def _wide(r: Column, cell: float) -> Column:
    """Whether a rectangle covers too many cells, or some that are too far off to number."""
    n = R.normalized(r)
    out = ((n["right"] - n["left"]) / cell + 2) * ((n["bottom"] - n["top"]) / cell + 2) > MOST_CELLS
    for name in R.SIDES:
        out = out | ~(F.abs(n[name]) < FARTHEST)
    return out


def _cell(x: Column, y: Column, meeting: int = 0) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(meeting).alias("meeting"))


def _meeting(which: int) -> Column:
    """A cell off the grid: 1 for wide queries and all blocks, 2 for wide blocks and narrow queries."""
    return _cell(F.lit(0), F.lit(0), which)


def _cells(r: Column, cell: float) -> Column:
    n = R.normalized(r)
    span = lambda lo, hi: F.sequence(F.floor(n[lo] / cell).cast("long"), F.floor(n[hi] / cell).cast("long"))
    return F.flatten(F.transform(span("left", "right"), lambda x: F.transform(span("top", "bottom"), lambda y: _cell(x, y))))


def search_join(blocks: DataFrame, queries: DataFrame, overlap: float = 0.0, on: tuple[str, ...] = ("doc_id",), cell: float = CELL) -> DataFrame:
    """Every (query, block) that hit: queries has the columns on, query_id and query.

    Rectangles that cover at most MOST_CELLS grid cells go to these cells, and both sides
    meet in an equi-join on (on, cell), which shuffles and splits skew like any other; a
    pair that shares several cells is kept in one, that of the top left corner of the
    shared area. A wider query, whose pairs are many anyway, goes to one cell in which
    every block of the same keys is, and a wider block to one with every narrow query.
    """
    block, query = R.normalized(F.col("bbox")), F.col("query")
    b = blocks.where(R.is_finite(F.col("bbox")) & (R.area(F.col("bbox")) > 0))
    wide = _wide(F.col("bbox"), cell)
    b = b.withColumn("__cell", F.explode(F.when(wide, F.array(_meeting(1), _meeting(2))).otherwise(F.concat(_cells(F.col("bbox"), cell), F.array(_meeting(1))))))
    q = queries.withColumn("query", R.normalized(F.col("query")))
    wide = _wide(F.col("query"), cell)
    q = q.withColumn("__cell", F.explode(F.when(wide, F.array(_meeting(1))).otherwise(F.concat(_cells(F.col("query"), cell), F.array(_meeting(2))))))
    owner = _cell(F.floor(F.greatest(block["left"], query["left"]) / cell), F.floor(F.greatest(block["top"], query["top"]) / cell))
    own = F.when(F.col("__cell")["meeting"] > 0, True).otherwise(F.col("__cell") == owner)
    return q.join(b, [*on, "__cell"]).where(own & hits(F.col("bbox"), query, overlap)).drop("__cell")


_UNDER = T.ArrayType(T.ArrayType(T.IntegerType()))


@F.arrow_udf(_UNDER)
def _touched(parts: pa.Array, lines: pa.Array, sizes: pa.Array) -> pa.Array:
    """For each non-empty match of a page the places of the blocks it touches. parts of a marked body: each one's length, and that of the match it begins with, -1 for none; then the places of the blocks of each line, and in that order the sizes of their texts, each followed by one separator."""
    flat = parts.flatten()
    size, match = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("size", "match"))
    cut = np.concatenate([[0], np.cumsum(parts.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    page = np.repeat(np.arange(len(parts)), np.diff(cut))
    used = size - (match >= 0)
    at = np.cumsum(used) - used
    at -= at[cut[:-1]][page] if len(at) else 0
    on = match > 0
    begin, end, page = at[on].astype(np.int64), (at + match)[on].astype(np.int64), page[on]
    n = sizes.value_lengths().fill_null(0).to_numpy()
    long, place, of = sizes.flatten().to_numpy().astype(np.int64), lines.flatten().flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    start = np.cumsum(long + 1) - long - 1
    start -= start[(np.cumsum(n) - n)[of]] if len(of) else 0
    ink = long > 0
    start, long, place, of = start[ink], long[ink], place[ink], of[ink]
    # one axis for all pages: bodies end to end
    far = np.int64(max(int((start + long).max(initial=0)), int(end.max(initial=0))) + 1)
    first = np.searchsorted(of * far + start + long, page * far + begin, side="right")
    count = np.maximum(np.searchsorted(of * far + start, page * far + end, side="left") - first, 0)
    offsets = np.concatenate([[0], np.cumsum(count)])
    under = np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])
    return lists(np.searchsorted(page, np.arange(len(parts) + 1)), lists(offsets, pa.array(place[under].astype(np.int32))))


def _matched(blocks: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, page_index, blocks, under): pages with the places of the blocks that each non-empty match touches."""
    marked = F.regexp_replace(body_of(), F.lit(f"(?:{java(pattern)})"), F.lit(f"{OPEN}$0{CLOSE}"))
    # each argument is one expression, so that none is worked out twice
    parts = F.transform(F.split(marked, OPEN), lambda p: F.struct(F.length(p).alias("size"), (F.instr(p, CLOSE) - 1).cast("int").alias("match")))
    sizes = F.transform(F.flatten("lines"), lambda i: F.length(plain(F.get("blocks", i)["text"])))
    return ordered_pages(blocks).withColumn("under", _touched(parts, "lines", sizes)).select("doc_id", "page_index", "blocks", "under")


def _blocks_under() -> Column:
    return F.transform("under", lambda u: F.transform(u, lambda i: F.get("blocks", i)))


def _each(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name])


def _union_of(b: Column) -> Column:
    side = lambda f, n: f(F.transform(b, lambda x: x[n]))
    return R.rect(side(F.array_min, "top"), side(F.array_min, "left"), side(F.array_max, "bottom"), side(F.array_max, "right"))


def _text_of(b: Column) -> Column:
    return F.array_join(F.transform(b, lambda x: plain(x["text"])), " ")


def search_regex(blocks: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, page_index, match_no, block_ids, text, bbox) of each non-empty match in a page's body, without regard to case: the whole blocks touched, joined by spaces, and their union.

    Java brackets each match with marks; an Arrow UDF gets lengths only, and finds by
    binary search which blocks lie under a match.
    """
    found = _matched(blocks, pattern).select("doc_id", "page_index", F.posexplode(_blocks_under()).alias("match_no", "__b")).where(F.size("__b") > 0)
    b = F.col("__b")
    return found.select("doc_id", "page_index", "match_no", F.transform(b, lambda x: x["block_id"]).alias("block_ids"), _text_of(b).alias("text"), _union_of(b).alias("bbox"))


def has_regex(blocks: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, found): whether any page's body matches; here an empty match counts."""
    return bodies(blocks).groupBy("doc_id").agg(F.bool_or(F.col("body").rlike(java(pattern))).alias("found"))


_LTRB = ("left", "top", "right", "bottom")
_PAIRS = T.ArrayType(T.StructType([T.StructField("label", T.IntegerType()), T.StructField("block", T.IntegerType())]))


def _hit_pairs(overlap: float) -> Callable[..., Column]:
    """An Arrow UDF over documents: from the left, top, right and bottom of queries and of blocks, all pairs that hits() finds."""
    share = clamped_share(overlap)

    def sides(*arrays: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        a, b, c, d = (np.asarray(x.flatten().to_numpy(zero_copy_only=False), float) for x in arrays)
        return [np.minimum(a, c), np.minimum(b, d), np.maximum(a, c), np.maximum(b, d)], np.concatenate([[0], np.cumsum(arrays[0].value_lengths().fill_null(0).to_numpy())]).astype(np.int64)

    def pairs(query: list[np.ndarray], block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, top, right, bottom = block
        fine = np.flatnonzero(np.isfinite(left) & np.isfinite(top) & np.isfinite(right) & np.isfinite(bottom) & ((right - left) * (bottom - top) > 0))
        fine = fine[np.argsort(top[fine], kind="stable")]
        left, top, right, bottom = (x[fine] for x in block)
        known = np.flatnonzero(~np.isnan(query).any(axis=0))
        q_left, q_top, q_right, q_bottom = (x[known] for x in query)
        # by top, blocks from the first that reaches a query to the last that begins above its end
        first = np.searchsorted(np.maximum.accumulate(bottom), q_top, side="left")
        n = np.maximum(np.searchsorted(top, q_bottom, side="right") - first, 0)
        q = np.repeat(np.arange(len(known)), n)
        b = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        wide = np.minimum(right[b], q_right[q]) - np.maximum(left[b], q_left[q])
        high = np.minimum(bottom[b], q_bottom[q]) - np.maximum(top[b], q_top[q])
        area = (right[b] - left[b]) * (bottom[b] - top[b])
        ok = (wide >= 0) & (high >= 0) & (np.maximum(wide, 0.0) * np.maximum(high, 0.0) >= area * share)
        return known[q[ok]], fine[b[ok]]

    @F.arrow_udf(_PAIRS)
    def run(*arrays: pa.Array) -> pa.Array:
        (q, q_at), (b, b_at) = sides(*arrays[:4]), sides(*arrays[4:])
        out = [pairs([x[i:j] for x in q], [x[k:m] for x in b]) for i, j, k, m in zip(q_at, q_at[1:], b_at, b_at[1:])]
        one, two = (np.concatenate([x[n] for x in out]) if out else np.zeros(0) for n in (0, 1))
        made = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (one, two)], names=["label", "block"])
        return lists(np.concatenate([[0], np.cumsum([len(x[0]) for x in out])]), made)

    return run


def right_of_label(blocks: DataFrame, pattern: str, reach: float, overlap: float = 0.3) -> DataFrame:
    """For each match of a label, the blocks up to reach to its right: (doc_id, page_index, match_no, label, block_id, text).

    A page's blocks are shuffled once, as they may lie beside a label of any page of
    their document; a document is one row then, and pairs are found inside it.
    """

    def label(u: Column, no: Column) -> Column:
        b = F.transform(u, lambda i: F.get("blocks", i))
        box = _union_of(b)
        return F.struct(F.col("page_index").alias("page_index"), no.alias("match_no"), _text_of(b).alias("label"), box["top"].alias("top"), box["right"].alias("left"), box["bottom"].alias("bottom"), (box["right"] + reach).alias("right"))

    made = F.filter(F.transform("under", lambda u, no: F.when(F.size(u) > 0, label(u, no))), lambda x: x.isNotNull())
    # a list a column: sides repeat, so that they take little room in a shuffle
    lists_of = [_each("blocks", n).alias(n) for n in ("block_id", "text", *_LTRB)]
    docs = _matched(blocks, pattern).select("doc_id", F.struct(*lists_of, made.alias("labels")).alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("p"))
    docs = docs.select("doc_id", *(F.flatten(_each("p", n)).alias(n) for n in ("block_id", "text", *_LTRB, "labels"))).where(F.size("labels") > 0)
    docs = docs.withColumn("__pairs", _hit_pairs(overlap)(*(_each("labels", n) for n in _LTRB), *_LTRB))
    found = F.transform("__pairs", lambda p: F.struct(F.get("labels", p["label"]).alias("l"), F.get("block_id", p["block"]).alias("block_id"), F.get("text", p["block"]).alias("text")))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.l.page_index", "x.l.match_no", "x.l.label", "x.block_id", "x.text")
