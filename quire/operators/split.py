"""Splitting blocks at a match."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rect as R
from quire.functions.regex import java, offsets

from .pages import arrow_type

#: The cuts of a block: where the match begins and ends in its text, and among its characters.
_CUTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "i", "j")])


class SplitError(ValueError):
    pass


def cuts_of(text: str, chars: Iterable[str], pattern: regex.Pattern) -> tuple[int, int, int, int] | None:
    """Where a block is cut at the first non-empty match (its first group, if that took part), or None to leave it.

    Spaces in the text that stand for no character take none; other characters of the
    text are looked for in order, and if one is missing the block is left.
    """
    found = ((m.start(g), m.end(g)) for m in pattern.finditer(text) for g in [1 if pattern.groups and m.start(1) >= 0 else 0])
    at = next(((a, b) for a, b in found if a < b), None)
    if at is None:
        return None
    chars = list(chars)
    if len(chars) == len(text) and "".join(chars) == text and not any(ch.isspace() for ch in text):
        return (*at, *at)
    place, used = [0], 0
    for ch in text:
        if not ch.isspace():
            while used < len(chars) and chars[used] != ch:
                used += 1
            if used == len(chars):
                return None
            used += 1
        place.append(used)
    return (*at, place[at[0]], place[at[1]])


def _ranges(cuts: Column) -> Column:
    """The up to three parts of a block at its cuts, as ranges of its text and its characters, with one of each at least."""
    part = lambda a, b, i, j: F.struct(a.alias("a"), b.alias("b"), i.alias("i"), j.alias("j"))
    a, b, i, j = (cuts[n] for n in "abij")
    zero = F.lit(0)
    three = F.array(part(zero, a, zero, i), part(a, b, i, j), part(b, F.length("text"), j, F.size("__cs")))
    return F.filter(three, lambda p: (p["a"] < p["b"]) & (p["i"] < p["j"]))


def split(blocks: DataFrame, pattern: str, boundaries: R.Rectangle | None = None) -> DataFrame:
    """Blocks cut at the first non-empty match of a pattern, without regard to case; only blocks wholly inside boundaries, if given. Needs characters. Numbered anew, in order.

    Python sees the text and the characters, without places, of blocks with a match, and answers with numbers.
    """
    java(pattern)  # the same dialect as in searches
    if "chars" not in blocks.columns:
        raise SplitError("splitting needs blocks with chars")
    compiled = offsets(pattern)

    @F.arrow_udf(_CUTS)
    def cuts(texts: pa.Array, chars: pa.Array) -> pa.Array:
        out: list = [None] * len(texts)
        for i in texts.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
            found = cuts_of(texts[i].as_py(), chars[i].as_py() or [], compiled)
            out[i] = found and dict(zip("abij", found))
        return pa.array(out, arrow_type(_CUTS))

    inside = F.lit(True) if boundaries is None else R.overlaps(F.col("bbox"), boundaries.literal(), 1.0)
    # the UDF runs for every row, but blocks without a match give it nulls; their characters are worked out only if the answer's are used
    asked = blocks.withColumn("__cs", F.when(inside & F.col("text").rlike(java(pattern)), F.col("chars")))
    cut = asked.withColumn("__cuts", cuts(F.when(F.col("__cs").isNotNull(), F.col("text")), F.transform("__cs", lambda c: c["ch"])))
    out = cut.withColumn("__n", F.when(F.col("__cuts").isNotNull(), _ranges(F.col("__cuts"))))
    none = F.struct(*(F.lit(None).cast("int").alias(n) for n in "abij"))
    out = out.select("doc_id", "block_id", "page_index", "text", "bbox", "chars", "__cs", F.posexplode(F.when(F.size("__n") > 0, F.col("__n")).otherwise(F.array(none))).alias("__n", "__r"))
    r, cs = F.col("__r"), F.col("__cs")
    own = F.slice(cs, r["i"] + 1, r["j"] - r["i"])
    side = lambda f, name: f(F.transform(own, lambda c: c["bbox"][name]))
    part = r["i"].isNotNull()
    text = F.when(part, F.substring("text", r["a"] + 1, r["b"] - r["a"])).otherwise(F.col("text"))
    b = F.col("bbox")
    pick = lambda f, name: F.when(part, side(f, name)).otherwise(b[name])
    box = R.rect(pick(F.array_min, "top"), pick(F.array_min, "left"), pick(F.array_max, "bottom"), pick(F.array_max, "right"))
    out = out.select("doc_id", "block_id", "page_index", "__n", text.alias("text"), box.alias("bbox"), F.when(part, own).otherwise(F.col("chars")).alias("chars"))
    w = Window.partitionBy("doc_id").orderBy("block_id", "__n")
    return out.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("block_id"), "page_index", "text", "bbox", "chars")
