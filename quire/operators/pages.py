"""Folds over the blocks of a page.

The three order-dependent folds (lines, common heights of lines, merged groups) take
a page as one row holding an array of its blocks. Python workers get batches of pages'
coordinates as flat arrays and answer with places; no group is ever larger than a page.

Operators take blocks as rows or as pages, which are rows of page_rows' form. Blocks
that are pages from the start, as those of a layout made a document at a time, are
never exploded and regrouped: nothing but answers is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rect as R

# A block joins a line that covers this share of its height, unless the line's first block is this much taller (fixed values).
LINE_SHARE, LINE_TALLER = 0.8, 1.5
SAME_LINE = 0.5
#: Arrow batches to Python workers: by bytes, as a row is a document, a page or a word.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def is_pages(blocks: DataFrame) -> bool:
    return "blocks" in blocks.columns


def page_rows(blocks: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page_index, blocks array<struct<block_id, text, left, top, right, bottom, ...>>), in block order; pages stay as they are."""
    bounded(blocks.sparkSession)
    if is_pages(blocks):
        return blocks
    b = F.col("bbox")
    item = F.struct("block_id", "text", *(b[n].alias(n) for n in ("left", "top", "right", "bottom")), *more)
    return blocks.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(item)).alias("blocks"))


def block_rows(pages: DataFrame, blocks: Column | None = None, *more: str) -> DataFrame:
    """Pages as rows (doc_id, block_id, page_index, text, bbox, ...)."""
    # a generator over an expression: over a column Spark would add a filter on its size, and work the column out twice
    items = F.flatten(F.array(F.col("blocks") if blocks is None else blocks))
    b = F.col("b")
    box = R.rect(*(b[n] for n in R.SIDES))
    return pages.select("doc_id", "page_index", F.explode(items).alias("b")).select("doc_id", b["block_id"].alias("block_id"), "page_index", b["text"].alias("text"), box.alias("bbox"), *(b[c].alias(c) for c in more))


#: The blocks of a page without more columns.
PAGE_BLOCKS = T.ArrayType(T.StructType([T.StructField("block_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("left", "top", "right", "bottom"))]))

#: What a fold sees of a single page: for each name a list with an element a block.
Page = dict[str, list]


def geometry(blocks: DataFrame, **more: Callable[[Column], Column]) -> Column:
    """What a fold is given of pages: their blocks as they are if these hold nothing but a text and its box, else the sides and what more makes of each; characters stay in the JVM."""
    if not more and blocks.schema["blocks"].dataType.simpleString() == PAGE_BLOCKS.simpleString():
        return F.col("blocks")
    return F.transform("blocks", lambda b: F.struct(*(b[n].alias(n) for n in ("left", "top", "right", "bottom")), *(f(b).alias(n) for n, f in more.items())))


@dataclass
class Pages:
    """The blocks of some pages as flat arrays: for each name one value a block, page by page. Coordinates that are null are NaN."""

    fields: dict[str, np.ndarray]
    first: np.ndarray  # each page's first block, and their number

    @classmethod
    def one(cls, page: Page) -> Pages:
        return cls({k: np.asarray(v, float) for k, v in page.items()}, np.array([0, len(page["left"])]))

    def __len__(self) -> int:
        return int(self.first[-1])

    @cached_property
    def page(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @cached_property
    def sides(self) -> tuple[np.ndarray, ...]:
        """Normalised left, top, right and bottom."""
        a, b, c, d = (self.fields[n] for n in ("left", "top", "right", "bottom"))
        return np.where(c < a, c, a), np.where(d < b, d, b), np.where(c > a, c, a), np.where(d > b, d, b)

    def sorted(self, *names: str) -> np.ndarray:
        """Blocks by page, then by raw sides, then by place."""
        return np.lexsort((*(self.fields[n] for n in reversed(names)), self.page))

    def places(self, at: np.ndarray) -> pa.Array:
        """Blocks by their places inside their pages."""
        return pa.array((at - self.first[self.page[at]]).astype(np.int32))

    def of_page(self, pages: np.ndarray) -> np.ndarray:
        """List offsets of items whose pages are given in order."""
        return np.searchsorted(pages, np.arange(len(self.first))).astype(np.int32)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def fold(result: T.DataType, work: Callable[[Pages], pa.Array]) -> Callable[[Column], Column]:
    """An Arrow UDF: work applied to the geometry of a batch of pages; its answer has an element a page."""
    kind = arrow_type(result)

    @F.arrow_udf(result)
    def run(pages: pa.Array) -> pa.Array:
        flat = pages.flatten()
        fields = {f.name: x.fill_null(False).to_numpy(zero_copy_only=False) if pa.types.is_boolean(f.type) else x.to_numpy(zero_copy_only=False) for f, x in zip(flat.type, flat.flatten()) if f.name not in ("block_id", "text")}
        first = np.concatenate([[0], np.cumsum(pages.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        return work(Pages(fields, first)).cast(kind)

    return run


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _runs(page: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Where runs of blocks with the same page, top and bottom begin; one without height is a run of its own."""
    new = np.ones(len(page), bool)
    new[1:] = ~((page[1:] == page[:-1]) & (top[1:] == top[:-1]) & (bottom[1:] == bottom[:-1]) & (bottom[1:] > top[1:]))
    return np.flatnonzero(new)


def line_order(pages: Pages) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in reading order, and where in it each line begins.

    Blocks come by top, left, right, place. Each joins the line whose first block
    covers the largest share of its height (then the nearest top, then the first), if
    that is at least LINE_SHARE and the first block is not too tall; else it starts one.
    Blocks in a row with the same top and bottom join the same line, so one of each run is judged.
    """
    left, top, right, bottom = pages.sides
    order = np.lexsort((right, left, top, pages.page))
    tops, bottoms = top[order], bottom[order]
    runs = _runs(pages.page[order], tops, bottoms)
    line_top: list[float] = []
    line_bottom: list[float] = []
    line_of = []
    near: list[int] = []  # from the top down: other lines end above all blocks to come
    now = -1
    for page, t, b in zip(pages.page[order][runs].tolist(), tops[runs].tolist(), bottoms[runs].tolist()):
        if page != now:
            now, near = page, []
        tall, best = b - t, None
        near = [k for k in near if line_bottom[k] > t]
        if tall > 0:
            for k in near:
                share = (min(line_bottom[k], b) - max(line_top[k], t)) / tall
                if share >= LINE_SHARE and line_bottom[k] - line_top[k] <= tall * LINE_TALLER:
                    rank = (-share, abs(line_top[k] - t), k)
                    best = min(best, rank) if best else rank
        if best:
            line_of.append(best[2])
        else:
            near.append(len(line_top))
            line_of.append(len(line_top))
            line_top.append(t)
            line_bottom.append(b)
    line = np.empty(len(order), np.int64)
    line[order] = np.repeat(np.array(line_of, np.int64), np.diff(np.append(runs, len(order))))
    leftmost = np.full(len(line_top), np.inf)
    np.fmin.at(leftmost, line, left)
    page = np.zeros(len(line_top), np.int64)
    page[line] = pages.page
    rank = np.empty(len(line_top), np.int64)
    rank[np.lexsort((leftmost, np.array(line_top), page))] = np.arange(len(line_top))
    line = rank[line]
    out = np.lexsort((pages.fields["right"], pages.fields["top"], pages.fields["left"], line))
    return out, np.flatnonzero(np.diff(line[out], prepend=-1))


def cluster_lines(page: Page) -> list[list[int]]:
    """Places of the blocks of each line of a page, in reading order."""
    order, starts = line_order(Pages.one(page))
    return [x.tolist() for x in np.split(order, starts[1:])] if len(order) else []


def line_heights(pages: Pages) -> pa.Array:
    """For each block the mean top and bottom of its line. Blocks come by top, left, right; a line ends at the first block that neither overlaps its first block by over half nor is so overlapped."""
    _, top, _, bottom = pages.sides
    order = pages.sorted("top", "left", "right")
    tops, bottoms = top[order], bottom[order]
    runs = _runs(pages.page[order], tops, bottoms)
    starts = []
    now, t1, b1 = -1, 0.0, 0.0
    for at, page, t, b in zip(runs.tolist(), pages.page[order][runs].tolist(), tops[runs].tolist(), bottoms[runs].tolist()):
        shared = max(min(b1, b) - max(t1, t), 0.0)
        if page != now or not any(h > 0 and shared / h > SAME_LINE for h in (b1 - t1, b - t)):
            now, t1, b1 = page, t, b
            starts.append(at)
    size = np.diff(np.append(starts, len(order)))
    mean = []
    for sides in (tops.tolist(), bottoms.tolist()):
        mean.append(np.repeat([sum(sides[a : a + n]) / n for a, n in zip(starts, size.tolist())], size))
    alone = np.repeat(size == 1, size)
    even = {}
    for n, m in zip(("top", "bottom"), mean):
        even[n] = np.empty(len(order))
        even[n][order] = np.where(alone, pages.fields[n][order], m)
    return lists(pages.first, pa.StructArray.from_arrays([pa.array(even["top"]), pa.array(even["bottom"])], names=["top", "bottom"]))


#: Blocks above it that a block is compared with at once; what reaches further is looked for on its page by itself.
_ABOVE = 64


def _tied(pages: Pages, gap: float, never: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of blocks of one line at most gap apart, but those that are never merged directly."""
    left, top, right, bottom = pages.sides
    order = np.lexsort((top, pages.page))
    page, top, bottom = pages.page[order], top[order], bottom[order]
    deepest = np.concatenate([np.fmax.accumulate(bottom[a:b]) for a, b in zip(pages.first[:-1].tolist(), pages.first[1:].tolist())] or [bottom])

    def judged(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = order[i], order[j]
        ok = ~(np.fmax(left[a] - right[b], left[b] - right[a]) > gap)
        shared = np.fmin(bottom[i], bottom[j]) - np.fmax(top[i], top[j])
        high, high2 = bottom[i] - top[i], bottom[j] - top[j]
        # a height of zero shares nothing, as shared is no more than it
        ok &= ((high > 0) & (shared > 0) & (shared / np.where(high > 0, high, 1) > SAME_LINE)) | ((high2 > 0) & (shared > 0) & (shared / np.where(high2 > 0, high2, 1) > SAME_LINE))
        for kind in never:
            ok &= ~(kind[a] & kind[b])
        return ok

    found = []
    i = np.arange(len(order))
    for above in range(1, _ABOVE + 1):
        i = i[i >= above]
        j = i - above
        # from the top down: only blocks that reach below this one's top can share its line
        reach = (page[j] == page[i]) & (deepest[j] > top[i])
        i, j = i[reach], j[reach]
        if not len(i):
            break
        ok = judged(i, j)
        found.append((i[ok], j[ok]))
    todo = set(i.tolist())
    for p in np.unique(page[i]).tolist() if todo else []:
        near: list[int] = []
        for k in range(int(pages.first[p]), int(pages.first[p + 1])):
            near = [x for x in near if bottom[x] > top[k]]
            if k in todo and near:
                far = np.array([x for x in near if x < k - _ABOVE], np.int64)
                ok = judged(np.full(len(far), k), far)
                found.append((np.full(int(ok.sum()), k), far[ok]))
            near.append(k)
    one, two = (np.concatenate([x[n] for x in found]) if found else np.zeros(0, np.int64) for n in (0, 1))
    return order[one], order[two]


def merge_groups(pages: Pages, gap: float, rules: tuple[bool, bool]) -> np.ndarray:
    """For each block the first block of its group: blocks of one line at most gap apart are tied, but a pair that the rules forbid is not tied directly."""
    root = np.arange(len(pages))
    one, two = _tied(pages, gap, [pages.fields[kind].astype(bool) for rule, kind in zip(rules, ("numeric", "date")) if rule])
    if len(one):
        up: dict[int, int] = {}

        def find(i: int) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = up.get(j, j)
                i = j
            return i

        for i, j in zip(one.tolist(), two.tolist()):
            a, b = find(i), find(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        for i in up:
            root[i] = find(i)
    return root


def group_lists(pages: Pages, gap: float, rules: tuple[bool, bool]) -> pa.Array:
    """The places of each merged group, by left, top and place."""
    root = merge_groups(pages, gap, rules)
    order = np.lexsort((pages.fields["top"], pages.fields["left"], root))
    starts = np.flatnonzero(np.diff(root[order], prepend=-1))
    return lists(pages.of_page(pages.page[order][starts]), lists(np.append(starts, len(order)), pages.places(order)))
