"""Queries over the test tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import derive
from quire.derive import RECTS_SQL, WORDS_SQL, advance, line_rects, table, word_blocks, word_pages
from quire.functions import color, expand, tokens
from quire.functions import rect as R
from quire.operators import layout, reading, scope, search, segment, split
from quire.operators.pages import block_rows
from quire.plans.layout_index import LayoutIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def sides(r: Column, prefix: str = "") -> list[Column]:
    return [r[n].alias(prefix + n) for n in R.SIDES]


# -- rectangle algebra -------------------------------------------------------------

def _rect_query(name: str, columns: Callable[[Column, Column], dict[str, Column]], sql: str) -> None:
    _add(name, lambda s, d: line_rects(s, d).select("k1", "k2", *(c.alias(n) for n, c in columns(F.col("a"), F.col("b")).items())), f"WITH {RECTS_SQL} SELECT k1, k2, {sql} FROM n")


def _sides_of(r: Column) -> dict[str, Column]:
    return {n: r[n] for n in R.SIDES}


_rect_query("rect_center", lambda a, b: {"x": R.center(b)["x"], "y": R.center(b)["y"]}, "(bl + br) / 2 AS x, (bt + bb) / 2 AS y")
_rect_query("rect_corner", lambda a, b: {"x": R.corner(b, "right", "top")["x"], "y": R.corner(b, "right", "top")["y"]}, "br AS x, bt AS y")
_rect_query("rect_normalize", lambda a, b: _sides_of(R.normalized(b)), 'bb AS top, bl AS "left", bt AS bottom, br AS "right"')
_rect_query("rect_margin", lambda a, b: _sides_of(R.with_margin(b, 1, 2, 3, 4)), 'bb - 1 AS top, bl - 3 AS "left", bt + 2 AS bottom, br + 4 AS "right"')
_rect_query("rect_with", lambda a, b: _sides_of(R.with_coords(b, left=F.lit(5.0))), 'bt AS top, CAST(5 AS DOUBLE) AS "left", bb AS bottom, br AS "right"')
_rect_query("rect_validate", lambda a, b: {"valid": R.is_valid(a)}, "ar > al AND ab > ay AS valid")
_rect_query("rect_area", lambda a, b: {"area": R.area(b), "shared": R.intersection_area(a, b)}, "(br - bl) * (bt - bb) AS area, sx * sy AS shared")
_rect_query("rect_intersects", lambda a, b: {"touch": R.intersects(a, b)}, "gx >= 0 AND gy >= 0 AS touch")
_rect_query("rect_overlap_pct", lambda a, b: {"share": R.overlap_percentage(a, b)}, "CASE WHEN area > 0 THEN sx * sy / area ELSE 0 END AS share")
_rect_query("rect_overlaps", lambda a, b: {"any_": R.overlaps(a, b), "third": R.overlaps(a, b, 0.33)}, "gx > 0 AND gy > 0 AS any_, gx > 0 AND gy > 0 AND sx * sy / area >= 0.33::DOUBLE AS third")
_rect_query("rect_overlaps_margins", lambda a, b: {"near": R.overlaps_with_margins(a, b, 3, 4, 5, 6)}, "least(ar + 6, br) > greatest(al - 5, bl) AND least(ab + 4, bt) > greatest(ay - 3, bb) AS near")
_rect_query("rect_overlaps_h", lambda a, b: {"beside": R.overlaps_horizontally(a, b)}, "gx > 0 AS beside")
_rect_query("rect_contains_left", lambda a, b: {"holds": R.contains_left_side(a, b)}, "al <= bl + 0.2::DOUBLE AND ay <= bb + 0.2::DOUBLE AND ab >= bt - 0.2::DOUBLE AS holds")
_rect_query("rect_vertical_overlap", lambda a, b: {"half": R.vertical_overlap(a, b, 0.5)}, "ab > ay AND sy / (ab - ay) > 0.5 AS half")
_rect_query("rect_distance", lambda a, b: {"dist": F.round(R.distance(a, b), 6)}, "round(sqrt(pow((al + ar) / 2 - (bl + br) / 2, 2) + pow((ay + ab) / 2 - (bt + bb) / 2, 2)), 6) AS dist")
_rect_query("point_distance", lambda a, b: {"dist": F.round(R.point_distance(R.corner(a, "left", "top"), R.corner(b, "right", "bottom")), 6)}, "round(sqrt(pow(al - br, 2) + pow(ay - bb, 2)), 6) AS dist")
_rect_query("rect_gap", lambda a, b: {"gap": R.horizontal_gap(a, b)}, "greatest(-gx, 0) AS gap")
_rect_query("rect_union", lambda a, b: _sides_of(R.union(a, R.normalized(b))), 'least(ay, bb) AS top, least(al, bl) AS "left", greatest(ab, bt) AS bottom, greatest(ar, br) AS "right"')


def _as_blocks(s, d) -> DataFrame:
    return line_rects(s, d).select(F.lit(0).alias("doc_id"), "page_index", F.col("a").alias("bbox"))


_add("page_rects_inferred", lambda s, d: layout.infer_page_rects(_as_blocks(s, d)).select("doc_id", "page_index", *sides(F.col("rect"))), f'WITH {RECTS_SQL} SELECT 0 AS doc_id, page_index, min(ay) AS top, min(al) AS "left", max(ab) AS bottom, max(ar) AS "right" FROM n GROUP BY page_index')
_add("rect_union_doc", lambda s, d: layout.document_rects(layout.infer_page_rects(_as_blocks(s, d))).select("doc_id", *sides(F.col("rect"))), f'WITH {RECTS_SQL} SELECT 0 AS doc_id, min(ay) AS top, min(al) AS "left", max(ab) AS bottom, max(ar) AS "right" FROM n')


def _expanded(s, d, directions: list[str]) -> DataFrame:
    """Each part's rectangle grown among the line items of its page and column as blockers."""
    li = line_rects(s, d).select((F.col("k1") % 700).alias("g"), F.col("a").alias("blocker"))
    p = table(s, d, "part")
    left, top = F.col("p_partkey") % 400 + 50, F.col("p_partkey") % 600 + 50
    base = p.select("p_partkey", (F.col("p_partkey") % 700).alias("g"), R.rect(top, left, top + F.col("p_size") % 20 + 1, left + 30).alias("base"))
    return expand.expand_among(base, li, "g", directions, _BOUNDS).select("p_partkey", *sides(F.col("grown")))


_BOUNDS = R.Rectangle(0.0, 0.0, 800.0, 700.0)
_EXPAND_SQL = f"""WITH {RECTS_SQL},
p AS (SELECT p_partkey, p_partkey % 700 AS g, CAST(p_partkey % 600 + 50 AS DOUBLE) AS pt, CAST(p_partkey % 400 + 50 AS DOUBLE) AS pl, CAST(p_partkey % 600 + 50 + p_size % 20 + 1 AS DOUBLE) AS pb, CAST(p_partkey % 400 + 80 AS DOUBLE) AS pr FROM part),
j AS (SELECT p.*, n.* FROM p JOIN n ON p.g = n.k1 % 700)
SELECT p_partkey, """
_add(
    "expand_single_axis",
    lambda s, d: _expanded(s, d, ["left", "right"]),
    _EXPAND_SQL + """any_value(pt) AS top, any_value(pb) AS bottom,
  least(coalesce(max(ar) FILTER (WHERE ar <= pl AND greatest(ay, pt) < least(ab, pb)), 0), any_value(pl)) AS "left",
  greatest(coalesce(min(al) FILTER (WHERE al >= pr AND greatest(ay, pt) < least(ab, pb)), 700), any_value(pr)) AS "right" FROM j GROUP BY p_partkey""",
)
_add("expand_mixed", lambda s, d: _expanded(s, d, ["up", "right", "down"]))


# -- colours and tokens ------------------------------------------------------------


def _channels(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("g"), (F.col("l_quantity") / 50).alias("b"), (F.col("l_discount") * 2).alias("k"))


_LIN = "CASE WHEN {0} <= 0.04045::DOUBLE THEN {0} / 12.92::DOUBLE ELSE pow(({0} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_COLOR_SQL = f"""WITH c AS (SELECT l_orderkey AS k1, l_linenumber AS k2, least(l_discount * 10, 1) AS r, least(l_tax * 10, 1) AS g, l_quantity / 50 AS b, l_discount * 2 AS k FROM lineitem),
l AS (SELECT *, ({_LIN.format("r")}) * 0.2126::DOUBLE + ({_LIN.format("g")}) * 0.7152::DOUBLE + ({_LIN.format("b")}) * 0.0722::DOUBLE AS lum FROM c) SELECT k1, k2, """


def _lum() -> Column:
    return color.luminance(F.col("r"), F.col("g"), F.col("b"))


def _rgb() -> Column:
    return color.cmyk_to_rgb(F.col("r"), F.col("g"), F.col("b"), F.col("k"))



_add("luminance", lambda s, d: _channels(s, d).select("k1", "k2", F.round(_lum(), 6).alias("lum")), _COLOR_SQL + "round(lum, 6) AS lum FROM l")
_add("contrast", lambda s, d: _channels(s, d).select("k1", "k2", F.round(color.contrast_ratio(_lum(), F.lit(1.0)), 6).alias("ratio")), _COLOR_SQL + "round(1.05::DOUBLE / (lum + 0.05::DOUBLE), 6) AS ratio FROM l")
_add("cmyk_rgb", lambda s, d: _channels(s, d).select("k1", "k2", *(F.round(_rgb()[n], 6).alias(n) for n in "rgb")), _COLOR_SQL + "round(1 - least(r + k, 1), 6) AS r, round(1 - least(g + k, 1), 6) AS g, round(1 - least(b + k, 1), 6) AS b FROM c")


def _token_texts(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    day = F.date_format("l_shipdate", "MM/dd/yyyy")
    price = F.format_string("%.2f", "l_extendedprice")
    n = F.col("l_orderkey") % 8
    text = F.when(n == 0, price).when(n == 1, F.concat(F.lit("$"), price)).when(n == 2, F.concat(F.lit("("), price, F.lit(")"))).when(n == 3, day).when(n == 4, F.concat(day, F.lit("-"), day)).when(n == 5, F.concat(F.lit("1,2"), F.col("l_linenumber").cast("string"))).when(n == 6, F.concat(F.col("l_partkey").cast("string"), F.lit("-"))).otherwise(F.col("l_returnflag"))
    return li.select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), text.alias("text"))


_TOKEN_SQL = """WITH t AS (SELECT l_orderkey AS k1, l_linenumber AS k2, strftime(l_shipdate, '%m/%d/%Y') AS d, printf('%.2f', l_extendedprice) AS p, l_orderkey % 8 AS n, * FROM lineitem),
x AS (SELECT k1, k2, CASE n WHEN 0 THEN p WHEN 1 THEN '$' || p WHEN 2 THEN '(' || p || ')' WHEN 3 THEN d WHEN 4 THEN d || '-' || d WHEN 5 THEN '1,2' || l_linenumber WHEN 6 THEN l_partkey || '-' ELSE l_returnflag END AS text FROM t) SELECT k1, k2, text, """
_add("token_numeric", lambda s, d: _token_texts(s, d).withColumn("numeric", tokens.is_numeric_token(F.col("text"))), _TOKEN_SQL + f"regexp_matches(text, '{tokens.NUMERIC}') AND regexp_matches(text, '[0-9]') AS numeric FROM x")
_add("token_date", lambda s, d: _token_texts(s, d).withColumn("date", tokens.is_date_token(F.col("text"))), _TOKEN_SQL + f"regexp_matches(text, '{tokens.DATE}') AS date FROM x")


# -- layout ------------------------------------------------------------------------


def _raw_pages(s, d) -> DataFrame:
    """Each customer's orders as the pages of a document."""
    o = table(s, d, "orders")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("doc_id"), n.alias("page_index"), F.lit(5.0).alias("x_min"), F.lit(7.0).alias("y_min"), (F.col("o_orderkey") % 300 + 300).cast("double").alias("width"), (F.col("o_orderkey") % 400 + 400).cast("double").alias("height"), (F.col("o_orderkey") % 5 * 90).cast("int").alias("rotation"))


_PAGES_SQL = """o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page_index,
  CAST(o_orderkey % 300 + 300 AS DOUBLE) AS w, CAST(o_orderkey % 400 + 400 AS DOUBLE) AS h, CAST((o_orderkey % 5 * 90) % 360 AS INTEGER) AS rotation FROM orders),
q AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS rw, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS rh FROM o),
pages AS (SELECT *, coalesce(sum(rh) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y_offset FROM q)"""
_add("page_stack", lambda s, d: layout.stack_pages(_raw_pages(s, d)).select("doc_id", "page_index", "rotation", "rotated_width", "rotated_height", "y_offset", *sides(F.col("rect"))), f'WITH {_PAGES_SQL} SELECT doc_id, page_index, rotation, rw AS rotated_width, rh AS rotated_height, y_offset, y_offset AS top, CAST(0 AS DOUBLE) AS "left", y_offset + rh AS bottom, rw AS "right" FROM pages')


def _page_marks(s, d) -> DataFrame:
    """Two marks a page; the second reaches past it."""
    p = _raw_pages(s, d)
    one = R.rect(F.lit(20.0), F.lit(30.0), F.lit(50.0), F.lit(90.0))
    two = R.rect(F.lit(100.0), F.lit(-20.0), F.lit(60.0), F.lit(2000.0))
    out = R.rect(F.lit(-50.0), F.lit(0.0), F.lit(-20.0), F.lit(9.0))
    return p.select("doc_id", "page_index", F.posexplode(F.array(one, two, out)).alias("mark", "bbox"))


_add(
    "canonical_rotate",
    lambda s, d: layout.canonicalize(_page_marks(s, d), layout.stack_pages(_raw_pages(s, d))).select("doc_id", "page_index", "mark", *sides(F.col("bbox"))),
    f"""WITH {_PAGES_SQL}, m AS (SELECT * FROM (VALUES (0, 25.0, 85.0, 13.0, 43.0), (1, -25.0, 1995.0, 53.0, 93.0), (2, -5.0, 4.0, -57.0, -27.0)) t(mark, x1, x2, y1, y2)),
x AS (SELECT p.*, mark, CASE rotation WHEN 90 THEN y1 WHEN 180 THEN w - x2 WHEN 270 THEN h - y2 ELSE x1 END AS l, CASE rotation WHEN 90 THEN y2 WHEN 180 THEN w - x1 WHEN 270 THEN h - y1 ELSE x2 END AS r,
  CASE rotation WHEN 90 THEN w - x2 WHEN 180 THEN h - y2 WHEN 270 THEN x1 ELSE y1 END AS lo, CASE rotation WHEN 90 THEN w - x1 WHEN 180 THEN h - y1 WHEN 270 THEN x2 ELSE y2 END AS hi FROM pages p, m),
c AS (SELECT doc_id, page_index, mark, least(greatest(l, 0), rw) AS l, least(greatest(r, 0), rw) AS r, y_offset + (rh - least(greatest(hi, 0), rh)) AS t, y_offset + (rh - least(greatest(lo, 0), rh)) AS b FROM x)
SELECT doc_id, page_index, mark, CAST(t AS DOUBLE) AS top, CAST(l AS DOUBLE) AS "left", CAST(b AS DOUBLE) AS bottom, CAST(r AS DOUBLE) AS "right" FROM c WHERE l < r AND t < b""",
)


def _painted(s, d) -> DataFrame:
    """Each document's words set five times over on a small page, as pages of the first letters of the words."""
    def letter(b: Column) -> Column:
        at = (b["block_id"] % 40).cast("double")
        return F.struct(b["block_id"].alias("block_id"), F.substring(b["text"], 1, 1).alias("text"), at.alias("left"), F.lit(0.0).alias("top"), (at + 1).alias("right"), F.lit(10.0).alias("bottom"))

    return word_pages(s, d).withColumn("blocks", F.transform("blocks", letter))


_DEDUPE_SQL = f"WITH {WORDS_SQL} SELECT doc_id, page_index, substr(text, 1, 1) AS ch, min(block_id) AS seq, CAST(block_id % 40 AS DOUBLE) AS \"left\" FROM blocks GROUP BY doc_id, page_index, substr(text, 1, 1), block_id % 40"
_add("dedupe_chars", lambda s, d: layout.dedupe_chars(_painted(s, d)).select("doc_id", "page_index", "ch", "seq", F.col("bbox")["left"].alias("left")), _DEDUPE_SQL)
_add("dedupe_blocks", lambda s, d: layout.dedupe_blocks(_painted(s, d)).select("doc_id", "page_index", F.col("text").alias("ch"), F.col("block_id").alias("seq"), F.col("bbox")["left"].alias("left")), _DEDUPE_SQL)


def word_glyphs(s, d) -> DataFrame:
    """The characters of word_blocks in painting order, in page space."""
    w = word_blocks(s, d)
    b = F.col("bbox")
    chars = w.select("doc_id", "page_index", "block_id", F.col("text").alias("w"), "bbox", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    high = 792.0 - (b["top"] - F.col("page_index") * 792.0)
    low = 792.0 - (b["bottom"] - F.col("page_index") * 792.0)
    wide = advance(F.col("w"), b)
    left = b["left"] + F.col("i") * wide
    return chars.select("doc_id", "page_index", (F.col("block_id") * (1 << 31) + F.col("i")).alias("seq"), "ch", R.rect(low, left, high, left + wide).alias("bbox"), F.lit(10.0).alias("font_size"))


_add(
    "segment_words",
    lambda s, d: segment.segment(word_glyphs(s, d)).select("doc_id", "block_id", "page_index", "text", F.size("chars").alias("n_chars"), F.col("bbox")["left"].alias("left"), F.col("bbox")["right"].alias("right")),
    # a word is at most as wide as 14 letters, so none meets the next one and blocks are the words
    f'WITH {WORDS_SQL} SELECT doc_id, block_id, page_index, text, CAST(length(text) AS INTEGER) AS n_chars, "left", "right" FROM blocks',
)


def _ruled(s, d) -> DataFrame:
    """Words, some replaced by drawn rules."""
    k = F.col("block_id") % 9
    return word_blocks(s, d).withColumn("text", F.when(k == 0, "___").when(k == 1, "--").when(k == 2, "-_-_").otherwise(F.col("text")))


_add("drop_noise", lambda s, d: _ruled(s, d).where(~segment.is_noise(F.col("text"))).groupBy("doc_id", "page_index").agg(F.count("*").alias("n")), f"WITH {WORDS_SQL} SELECT doc_id, page_index, count(*) AS n FROM blocks WHERE block_id % 9 NOT IN (0, 2) GROUP BY doc_id, page_index")

# -- search ------------------------------------------------------------------------

_REGION = R.Rectangle(300.0, 100.0, 500.0, 400.0)
_HIT = "least(bottom, {b}) - greatest(top, {t}) >= 0 AND least(\"right\", {r}) - greatest(\"left\", {l}) >= 0 AND (\"right\" - \"left\") * (bottom - top) > 0 AND greatest(least(\"right\", {r}) - greatest(\"left\", {l}), 0) * greatest(least(bottom, {b}) - greatest(top, {t}), 0) >= (\"right\" - \"left\") * (bottom - top) * {s}::DOUBLE"
_add("search_region", lambda s, d: block_rows(search.search(word_pages(s, d), _REGION)).select("doc_id", "block_id", "text"), f"WITH {WORDS_SQL} SELECT doc_id, block_id, text FROM blocks WHERE {_HIT.format(t=300, l=100, b=500, r=400, s=0.00001)}")
_add("search_overlap", lambda s, d: block_rows(search.search(word_pages(s, d), _REGION, 0.75)).select("doc_id", "block_id", "text"), f"WITH {WORDS_SQL} SELECT doc_id, block_id, text FROM blocks WHERE {_HIT.format(t=300, l=100, b=500, r=400, s=0.75)}")


def _search_sides(s, d) -> tuple[DataFrame, DataFrame]:
    blocks = line_rects(s, d).select("page_index", "k1", "k2", F.col("a").alias("bbox"))
    p = table(s, d, "supplier")
    left, top = F.col("s_suppkey") * 13 % 450, F.col("s_suppkey") * 29 % 650
    queries = p.select((F.col("s_suppkey") % 10).cast("int").alias("page_index"), F.col("s_suppkey").alias("query_id"), R.rect(top, left, top + 40, left + 60).alias("query"))
    return blocks, queries


_add(
    "search_join",
    lambda s, d: search.search_join(*_search_sides(s, d), overlap=0.3, on=("page_index",)).select("query_id", "k1", "k2"),
    f"""WITH {RECTS_SQL}, q AS (SELECT s_suppkey AS query_id, CAST(s_suppkey % 10 AS INTEGER) AS pg, s_suppkey * 13 % 450 AS ql, s_suppkey * 29 % 650 AS qt FROM supplier)
SELECT query_id, k1, k2 FROM n JOIN q ON page_index = pg AND least(ar, ql + 60) > greatest(al, ql) AND least(ab, qt + 40) > greatest(ay, qt)
WHERE (least(ar, ql + 60) - greatest(al, ql)) * (least(ab, qt + 40) - greatest(ay, qt)) >= area * 0.3::DOUBLE""",
)

_BODY_SQL = f"""{WORDS_SQL},
lines AS (SELECT doc_id, page_index, line, string_agg(text, ' ' ORDER BY block_id) AS t, list(block_id ORDER BY block_id) AS ids FROM blocks GROUP BY doc_id, page_index, line),
bodies AS (SELECT doc_id, page_index, string_agg(t, chr(10) ORDER BY line) AS body FROM lines GROUP BY doc_id, page_index)"""
_add("reading_lines", lambda s, d: reading.lines(word_pages(s, d)).select("doc_id", "page_index", "line_no", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ",").alias("ids")), f"WITH {_BODY_SQL} SELECT doc_id, page_index, CAST(line - page_index * 50 AS INTEGER) AS line_no, array_to_string(ids, ',') AS ids FROM lines")
_add("reading_text", lambda s, d: reading.text(word_pages(s, d)), f"WITH {_BODY_SQL} SELECT doc_id, string_agg(body || chr(10), '' ORDER BY page_index) AS text FROM bodies GROUP BY doc_id")

#: A word and the one after it, across spaces and line ends.
_PATTERN = r"\b(the|der|les)\s+[a-z]{4,6}\b"
_add(
    "regex_search",
    lambda s, d: search.search_regex(word_pages(s, d), _PATTERN).select("doc_id", "page_index", "match_no", F.lower("text").alias("text")),
    # matches of bodies, whose words are whole blocks
    f"""WITH {_BODY_SQL}, m AS (SELECT doc_id, page_index, regexp_extract_all(lower(body), '{_PATTERN}') AS ms, body FROM bodies),
o AS (SELECT doc_id, page_index, body, unnest(ms) AS m, unnest(range(len(ms))) AS match_no FROM m),
g AS (SELECT doc_id, page_index, CAST(match_no AS INTEGER) AS match_no, replace(m, chr(10), ' ') AS text FROM o)
SELECT * FROM g""",
)
_add("has_regex", lambda s, d: search.has_regex(word_pages(s, d), "idiot|rß|the the"), f"WITH {_BODY_SQL} SELECT doc_id, bool_or(regexp_matches(body, '(?i)idiot|rß|the the')) AS found FROM bodies GROUP BY doc_id")
_add(
    "label_right_value",
    lambda s, d: search.right_of_label(word_pages(s, d), "^(?:and|und)$|\\b(?:and|und)\\b", 200.0).select("doc_id", "block_id", "text", F.lower("label").alias("label")),
    f"""WITH {WORDS_SQL} SELECT v.doc_id, v.block_id, v.text, lower(l.text) AS label FROM blocks l JOIN blocks v ON v.doc_id = l.doc_id AND v.line = l.line AND v.block_id > l.block_id
WHERE lower(l.text) IN ('and', 'und') AND least(v."right", l."right" + 200) - v."left" >= 0.3::DOUBLE * (v."right" - v."left")""",
)

# -- scope and split ---------------------------------------------------------------

_SCOPE = R.Rectangle(200.0, 0.0, 420.0, 612.0)
_SCOPE_HIT = _HIT.format(t=200, l=0, b=420, r=612, s=0.5)
_add("scope_filter", lambda s, d: scope.scoped(word_pages(s, d), _SCOPE, 0.5).select("doc_id", "block_id", "text"), f"WITH {WORDS_SQL} SELECT doc_id, block_id, text FROM blocks WHERE {_SCOPE_HIT}")


def _wavy(s, d) -> DataFrame:
    """Words that rise and fall a little along their line, as pages."""
    def moved(b: Column) -> Column:
        up = (b["block_id"] % 3).cast("double") / 4
        return F.struct(*(b[n].alias(n) for n in ("block_id", "text", "left")), (b["top"] + up).alias("top"), b["right"].alias("right"), (b["bottom"] + up).alias("bottom"))

    return word_pages(s, d).withColumn("blocks", F.transform("blocks", moved))


_add(
    "scope_normalize",
    lambda s, d: scope.normalize_lines(_wavy(s, d)).select("doc_id", "block_id", F.round(F.col("bbox")["top"], 6).alias("top"), F.round(F.col("bbox")["bottom"], 6).alias("bottom")),
    f"""WITH {WORDS_SQL} SELECT doc_id, block_id, round(avg(top + (block_id % 3) / 4.0::DOUBLE) OVER (PARTITION BY doc_id, line), 6) AS top, round(avg(bottom + (block_id % 3) / 4.0::DOUBLE) OVER (PARTITION BY doc_id, line), 6) AS bottom FROM blocks""",
)
_MERGE_SQL = f"""WITH {WORDS_SQL}, g AS (SELECT *, lag("right") OVER w AS pr, lag(text) OVER w AS pt FROM blocks WINDOW w AS (PARTITION BY doc_id, line ORDER BY block_id)),
h AS (SELECT *, sum(CASE WHEN pr IS NULL OR "left" - pr > 40 {{0}} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY block_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY block_id) AS text, min("left") AS "left", max("right") AS "right" FROM h GROUP BY doc_id, page_index, line, n"""
_merged = ("doc_id", "page_index", "text", "bbox.left", "bbox.right")
_EVERYWHERE = R.Rectangle(-1.0, -1.0, 1e9, 1e9)
_add("scope_merge", lambda s, d: scope.scoped(word_pages(s, d), _EVERYWHERE, 0.0, 40.0).select(*_merged), _MERGE_SQL.format(""))
# gaps of 40 points reach only the next word, so direct pairs are neighbours
_add(
    "scope_merge_rules",
    lambda s, d: scope.scoped(word_pages(s, d), _EVERYWHERE, 0.0, 40.0, rules=scope.MergeRules(no_numeric_pair_merge=True)).select(*_merged),
    _MERGE_SQL.format("OR (regexp_matches(text, '^[0-9]+$') AND regexp_matches(pt, '^[0-9]+$'))"),
)


def _with_chars(s, d) -> DataFrame:
    w = word_blocks(s, d)
    b = F.col("bbox")
    wide = advance(F.col("text"), b)
    one = lambda i: F.struct(F.substring("text", i + 1, F.lit(1)).alias("ch"), R.rect(b["top"], b["left"] + i * wide, b["bottom"], b["left"] + i * wide + wide).alias("bbox"))
    return w.withColumn("chars", F.transform(F.sequence(F.lit(0), F.length("text") - 1), one))


_SPLIT_SQL = f"""WITH {WORDS_SQL}, m AS (SELECT *, CASE WHEN {{0}} THEN regexp_extract(text, '(?i)(th|en)') ELSE '' END AS m FROM blocks),
p AS (SELECT *, CASE WHEN m = '' THEN 0 ELSE strpos(text, m) END AS ay FROM m),
x AS (SELECT doc_id, block_id, page_index, "left", ("right" - "left") / length(text) AS wide, unnest(CASE WHEN ay = 0 THEN [{{{{'t': text, 'o': 0}}}}] ELSE [{{{{'t': substr(text, 1, ay - 1), 'o': 0}}}}, {{{{'t': m, 'o': ay - 1}}}}, {{{{'t': substr(text, ay + 2), 'o': ay + 1}}}}] END) AS s FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_id, s.o) - 1 AS BIGINT) AS block_id, page_index, s.t AS text, "left" + s.o * wide AS "left" FROM x WHERE s.t <> ''""".replace("{{{{", "{{").replace("}}}}", "}}")
_parts = ("doc_id", "block_id", "page_index", "text", "bbox.left")
_add("split_label", lambda s, d: split.split(_with_chars(s, d), "(th|en)").select(*_parts), _SPLIT_SQL.format("true"))
_add("split_boundary", lambda s, d: split.split(_with_chars(s, d), "(th|en)", _SCOPE).select(*_parts), _SPLIT_SQL.format('top >= 200 AND bottom <= 420 AND "left" >= 0 AND "right" <= 612'))


# -- PDF files ---------------------------------------------------------------------


def _written_pdfs(s, d) -> DataFrame:
    """Each document's words set in a PDF file: (doc_id, content)."""
    from quire.sources.pdf.writer import text_page, write_pdf

    words = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("block_id"), b["text"].alias("text")))
    pages = word_pages(s, d).select("doc_id", F.struct("page_index", words.alias("ws")).alias("p")).groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))

    def run(batches):
        for batch in batches:
            files = []
            for ps in batch.column(1).to_pylist():
                bodies = [text_page([(36 + x["block_id"] % 6 * 96, 756 - x["block_id"] // 6 % 50 * 14, x["text"], min(100.0, 1400 / len(x["text"]))) for x in p["ws"]]) for p in ps]
                files.append(write_pdf(bodies))
            yield pa.record_batch([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return pages.mapInArrow(run, "doc_id long, content binary")


def _round_trip(s, d) -> LayoutIndex:
    return LayoutIndex.from_pdfs(_written_pdfs(s, d), keep_chars=False)


_add(
    "pdf_roundtrip_blocks",
    lambda s, d: _round_trip(s, d).blocks.select("doc_id", "block_id", "page_index", "text", *(F.round(F.col("bbox")[n], 3).alias(n) for n in R.SIDES)),
    f'WITH {WORDS_SQL} SELECT doc_id, block_id, page_index, text, round(top, 3) AS top, "left", round(bottom, 3) AS bottom, "right" FROM blocks',
)
_add("pdf_roundtrip_text", lambda s, d: _round_trip(s, d).text, ORACLES["reading_text"])
_add("pdf_pages", lambda s, d: _round_trip(s, d).page_rects.select("doc_id", "page_index", *sides(F.col("rect"))), f'WITH {WORDS_SQL} SELECT DISTINCT doc_id, page_index, page_index * 792.0::DOUBLE AS top, 0.0::DOUBLE AS "left", (page_index + 1) * 792.0::DOUBLE AS bottom, 612.0::DOUBLE AS "right" FROM blocks')

__all__ = ["ORACLES", "QUERIES", "derive"]
