"""Page stacking, canonical coordinates and removal of repeated paint, all as native plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rect as R

from .pages import is_pages


def stack_pages(pages: DataFrame) -> DataFrame:
    """pages with rotated_width, rotated_height, y_offset (heights of the pages before) and rect on the tall page. Rotations other than quarter turns count as none."""
    turn = F.pmod(F.col("rotation"), F.lit(360))
    turn = F.when(turn.isin(90, 180, 270), turn).otherwise(0).cast("int")
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    sideways = F.col("rotation").isin(90, 270)
    out = (
        pages.withColumn("rotation", turn)
        .withColumn("rotated_width", F.when(sideways, F.col("height")).otherwise(F.col("width")))
        .withColumn("rotated_height", F.when(sideways, F.col("width")).otherwise(F.col("height")))
        .withColumn("y_offset", F.coalesce(F.sum("rotated_height").over(before), F.lit(0.0)))
    )
    return out.withColumn("rect", R.rect(F.col("y_offset"), F.lit(0.0), F.col("y_offset") + F.col("rotated_height"), F.col("rotated_width")))


def canonical_rect(bbox: Column, page: Column) -> Column:
    """bbox of page space (y upwards) on the tall page: shifted, turned, clamped to the page, flipped, stacked. page holds the columns of stack_pages."""
    n = R.normalized(bbox)
    # y grows upwards here: "top" is the lower edge
    x1, x2 = n["left"] - page["x_min"], n["right"] - page["x_min"]
    y1, y2 = n["top"] - page["y_min"], n["bottom"] - page["y_min"]
    w, h, turn = page["width"], page["height"], page["rotation"]

    def by_turn(none: Column, quarter: Column, half: Column, three: Column) -> Column:
        return F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(none)

    def within(c: Column, most: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), most)

    left = within(by_turn(x1, y1, w - x2, h - y2), page["rotated_width"])
    right = within(by_turn(x2, y2, w - x1, h - y1), page["rotated_width"])
    low = within(by_turn(y1, w - x2, h - y2, x1), page["rotated_height"])
    high = within(by_turn(y2, w - x1, h - y1, x2), page["rotated_height"])
    return R.rect(page["y_offset"] + (page["rotated_height"] - high), left, page["y_offset"] + (page["rotated_height"] - low), right)


def canonicalize(rows: DataFrame, pages: DataFrame, bbox: str = "bbox") -> DataFrame:
    """rows with bbox on the tall page; what has no area there is dropped. pages: from stack_pages; a few columns a page, which the planner broadcasts or co-partitions by its size."""
    p = pages.select("doc_id", "page_index", F.struct("x_min", "y_min", "width", "height", "rotation", "rotated_width", "rotated_height", "y_offset").alias("__page"))
    out = rows.join(p, ["doc_id", "page_index"]).withColumn(bbox, canonical_rect(F.col(bbox), F.col("__page")))
    return out.where((F.col(bbox)["left"] < F.col(bbox)["right"]) & (F.col(bbox)["top"] < F.col(bbox)["bottom"])).select(*rows.columns)


def _first(rows: DataFrame, text: str, order: str, bbox: str = "bbox") -> DataFrame:
    key = [F.col("doc_id"), F.col("page_index"), F.col(text), *(F.col(bbox)[n] for n in R.SIDES)]
    if set(rows.columns) == {"doc_id", "page_index", text, bbox, order}:  # a hash aggregate, most of it before the shuffle
        sides = [c.alias(f"__{n}") for n, c in zip(R.SIDES, key[3:])]
        first = rows.groupBy(*key[:3], *sides).agg(F.min(order).alias(order))
        return first.withColumn(bbox, R.rect(*(F.col(f"__{n}") for n in R.SIDES))).select(*rows.columns)
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _first_of_pages(pages: DataFrame) -> DataFrame:
    """_first of pages, as rows: a page's blocks are sorted in its row, and nothing is shuffled or held for other pages."""
    key = lambda b: F.struct(b["text"].alias("text"), *(b[n].alias(n) for n in R.SIDES))
    ordered = pages.select("doc_id", "page_index", F.sort_array(F.transform("blocks", lambda b: F.struct(key(b).alias("key"), b["block_id"].alias("block_id")))).alias("x"))
    # each beside the one before it: a lambda that looked it up in the array would sort anew each time
    beside = F.arrays_zip(F.col("x"), F.concat(F.array(F.lit(None)), F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0)))).alias("p"))
    first = F.filter(beside, lambda z: ~z["x"]["key"].eqNullSafe(z["p"]["key"]))
    out = ordered.select("doc_id", "page_index", F.explode(first).alias("z")).select("doc_id", "page_index", "z.x.*")
    return out.select("doc_id", "block_id", "page_index", F.col("key.text").alias("text"), R.rect(*(F.col("key")[n] for n in R.SIDES)).alias("bbox"))


def dedupe_chars(chars: DataFrame) -> DataFrame:
    """The first of each character painted again at exactly the same place. Of pages, whose blocks are the characters and their numbers: rows (doc_id, page_index, seq, ch, bbox)."""
    if is_pages(chars):
        return _first_of_pages(chars).select("doc_id", "page_index", F.col("block_id").alias("seq"), F.col("text").alias("ch"), "bbox")
    return _first(chars, "ch", "seq")


def dedupe_blocks(blocks: DataFrame) -> DataFrame:
    """The first of each block with the same page, text and rectangle. Of pages: rows."""
    return _first_of_pages(blocks) if is_pages(blocks) else _first(blocks, "text", "block_id")


def infer_page_rects(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, rect): the union of each page's blocks. Pages without blocks up to the last get an empty rectangle, unless there are over 1,000,000 pages."""
    found = blocks.groupBy("doc_id", "page_index").agg(R.union_agg().alias("rect"))
    last = found.groupBy("doc_id").agg(F.max("page_index").alias("last"))
    gaps = last.where(F.col("last") + 1 <= 1_000_000).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page_index"))
    zero = R.rect(*(F.lit(0.0),) * 4)
    return found.join(gaps, ["doc_id", "page_index"], "full").withColumn("rect", F.coalesce("rect", zero))


def document_rects(page_rects: DataFrame) -> DataFrame:
    """(doc_id, rect): the union of each document's finite, non-empty page rectangles, or all zero."""
    r = F.col("rect")
    finite = F.lit(True)
    for n in R.SIDES:
        finite = finite & ~F.isnan(r[n]) & (F.abs(r[n]) < float("inf"))
    good = finite & R.is_valid(r)
    side = lambda f, n: F.coalesce(f(F.when(good, r[n])), F.lit(0.0))
    return page_rects.groupBy("doc_id").agg(R.rect(side(F.min, "top"), side(F.min, "left"), side(F.max, "bottom"), side(F.max, "right")).alias("rect"))
