"""Characters to word-level blocks: a gaps-and-islands plan.

Whether a character starts a block depends on the character before it on its page
alone, so a page's breaks and blocks are array expressions over one row a page, without
Python; only finished blocks are numbered by document, and no glyph is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rect as R

# Limits of a block (fixed values): height ratio, rise and gaps as shares of the character before, the least gap in points, change of font size.
TALLER, SHORTER = 1.35, 0.75
RISE = 0.5
GAP, LEAST_GAP, BACK = 0.10, 0.5, 2.0
FONT_CHANGE = 0.05
#: The 25 white-space characters of Unicode (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_noise(text: Column) -> Column:
    """Rules drawn with underscores or hyphens."""
    return text.rlike(r"^[_-]{3,}$") & ~text.contains("\n")


def _breaks(d: Column, c: Column) -> Column:
    """Whether a block ends between two characters (of _ink) of a page that have no other ink between them."""
    gap = c["left"] - d["right"]
    return (
        (c["at"] - d["at"] > 1)  # white space
        | (gap > F.greatest(d["tall"] * GAP, F.lit(LEAST_GAP)))
        | (gap < -BACK * d["tall"])
        | (F.abs(c["low"] - d["low"]) > RISE * d["tall"])
        | ((d["tall"] > 0) & ((c["tall"] / d["tall"] > TALLER) | (c["tall"] / d["tall"] < SHORTER)))
        | ((gap > LEAST_GAP) & d["ch"].rlike(r"^\p{Ll}") & c["ch"].rlike(r"^\p{Lu}"))
        | (F.abs(c["font_size"] - d["font_size"]) > FONT_CHANGE * d["font_size"])
    )


def _ink(g: Column, i: Column) -> Column:
    """A glyph with its place and normalised sides."""
    b = g["bbox"]
    low, left = F.least(b["top"], b["bottom"]), F.least(b["left"], b["right"])
    return F.struct(
        g["ch"].alias("ch"), b.alias("bbox"), g["font_size"].alias("font_size"), i.alias("at"),
        low.alias("low"), F.abs(b["bottom"] - b["top"]).alias("tall"), left.alias("left"), F.greatest(b["left"], b["right"]).alias("right"),
    )


def _blank(ch: Column) -> Column:
    return F.when(F.length(ch) == 1, F.instr(F.lit(WHITE), ch) > 0).otherwise(ch.rlike(r"^\p{IsWhite_Space}+$"))


def segment_pages(pages: DataFrame, keep_chars: bool = True) -> DataFrame:
    """(doc_id, block_id, page_index, text, bbox[, chars]) from one row a page with its glyphs (ch, bbox, font_size) in painting order."""
    ink = F.filter(F.transform("glyphs", _ink), lambda g: ~_blank(g["ch"]))
    pages = pages.select("doc_id", "page_index", ink.alias("__ink")).where(F.size("__ink") > 0)
    rest = F.size("__ink") - 1
    pairs = F.arrays_zip(F.slice("__ink", 1, rest).alias("a"), F.slice("__ink", 2, rest).alias("b"))
    cut = F.filter(F.transform(pairs, lambda x, i: F.when(_breaks(x["a"], x["b"]), i + 1)), lambda i: i.isNotNull())
    pages = pages.withColumn("__first", F.concat(F.array(F.lit(0)), cut))
    items = F.transform("__first", lambda i, k: F.slice("__ink", i + 1, F.coalesce(F.get("__first", k + 1), F.size("__ink")) - i))
    side = lambda x, f, n: f(F.transform(x, lambda g: g["bbox"][n]))

    def block(x: Column) -> Column:
        box = R.rect(side(x, F.array_min, "top"), side(x, F.array_min, "left"), side(x, F.array_max, "bottom"), side(x, F.array_max, "right"))
        chars = [F.transform(x, lambda g: F.struct(g["ch"].alias("ch"), g["bbox"].alias("bbox"))).alias("chars")] if keep_chars else []
        return F.struct(F.array_join(F.transform(x, lambda g: g["ch"]), "").alias("text"), box.alias("bbox"), *chars)

    done = pages.withColumn("__items", items).select("doc_id", "page_index", F.transform("__items", block).alias("__blocks"))
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    done = done.withColumn("__from", F.coalesce(F.sum(F.size("__blocks")).over(before), F.lit(0)))
    out = done.select("doc_id", "page_index", "__from", F.posexplode("__blocks").alias("__n", "b"))
    kept = ["b.text", "b.bbox", *(["b.chars"] if keep_chars else [])]
    return out.select("doc_id", (F.col("__from") + F.col("__n")).cast("long").alias("block_id"), "page_index", *kept).where(~is_noise(F.col("text")))


def segment(glyphs: DataFrame, keep_chars: bool = True) -> DataFrame:
    """(doc_id, block_id, page_index, text, bbox[, chars]) in page space, from glyphs in painting order (seq)."""
    size = F.col("font_size") if "font_size" in glyphs.columns else F.lit(None).cast("double")
    item = F.struct("seq", "ch", "bbox", size.alias("font_size"))
    return segment_pages(glyphs.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(item)).alias("glyphs")), keep_chars)
