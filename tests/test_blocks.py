import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.rect import Rectangle
from quire.functions.regex import PatternError, java
from quire.operators import layout, reading, scope, search, segment, split
from quire.operators.pages import cluster_lines
from quire.plans.layout_index import LayoutIndex
from quire.schemas import BLOCKS


def blocks(spark, rows, chars=False):
    """rows of (page, text, top, left, bottom, right)."""
    out = []
    for i, (page, text, t, left, b, r) in enumerate(rows):
        w = (r - left) / max(len(text), 1)
        cs = [(c, (float(t), left + k * w, float(b), left + (k + 1) * w)) for k, c in enumerate(text) if not c.isspace()]
        out.append(("d", i, page, text, (float(t), float(left), float(b), float(r)), cs if chars else None))
    df = spark.createDataFrame(out, BLOCKS)
    return df if chars else df.drop("chars")


def page_body(spark, rows):
    return reading.bodies(blocks(spark, rows)).orderBy("page_index").collect()


def test_lines_keep_big_text_apart(spark):
    rows = [(0, "pears", 48, 130, 56, 170), (0, "some", 48, 10, 56, 40), (0, "green", 48, 60, 57, 100), (0, "STOCK", 8, 10, 40, 90), (0, "LIST", 8, 110, 40, 180), (0, "sold", 70, 10, 78, 45)]
    assert page_body(spark, rows)[0].body == "STOCK LIST\nsome green pears\nsold"


def test_near_rows_and_short_blocks():
    page = lambda *boxes: {"top": [t for t, _, _ in boxes], "left": [x for _, x, _ in boxes], "bottom": [t + h for t, _, h in boxes], "right": [x + 5 for _, x, _ in boxes]}
    assert cluster_lines(page((10, 0, 10), (14, 0, 10), (10, 10, 10), (14, 10, 10))) == [[0, 2], [1, 3]]
    assert len(cluster_lines(page((10, 0, 2), (10, 10, 10)))) == 2
    assert cluster_lines(page((1, 0, 0), (1, 5, 0))) == [[0], [1]]


def test_regex_pages_and_case(spark):
    b = blocks(spark, [(0, "Alpha", 0, 0, 10, 20), (0, "beta", 12, 0, 22, 20), (1, "beta", 800, 0, 810, 20), (0, "gamma", 0, 30, 10, 50)])
    hit = search.search_regex(b, r"gamma\s+BETA").collect()
    assert [(r.text, list(r.block_ids), r.page_index) for r in hit] == [("gamma beta", [3, 1], 0)]
    assert tuple(hit[0].bbox) == (0, 0, 22, 50)
    assert search.search_regex(b, r"beta\s+beta").count() == 0
    assert search.search_regex(b, "x*").count() == 0  # empty matches
    assert search.has_regex(b, "x*").first().found
    assert reading.text(b).first().text == "Alpha gamma\nbeta\nbeta\n"
    for bad in ("(", r"(?=a)", r"(a)\1"):
        with pytest.raises(PatternError):
            search.search_regex(b, bad)
    assert java("[$]a$").endswith("[$]a\\z")


def test_regex_offsets_against_python(spark):
    r = random.Random(5)
    rows = [(p, "".join(r.choice("abé") for _ in range(r.randrange(1, 5))), 14 * line, 20 * k, 14 * line + 10, 20 * k + 15) for p in range(4) for line in range(5) for k in range(5)]
    b = blocks(spark, rows)
    for pattern in ("a+", "É", "ab|b a", r"\bb\b", r"a\s+b"):
        want = []
        for page in page_body(spark, rows):
            want += [(page.page_index, m.group()) for m in re.finditer(pattern, page.body, re.I) if m.group()]
        assert search.search_regex(b, pattern).count() == len(want), pattern


def test_search_join_equals_brute_force(spark):
    """Also boxes with NaN, infinite and empty sides, and rectangles of any extent."""
    nan, inf = float("nan"), float("inf")
    r = random.Random(2)
    box = lambda n: [(float(t := r.randrange(300)), float(x := r.randrange(300)), float(t + r.randrange(0, 90)), float(x + r.randrange(0, 90))) for _ in range(n)]
    bs = box(80) + [(nan,) * 4, (0.0, 0.0, nan, 9.0), (0.0, 0.0, inf, 9.0), (-1e7, -1e7, 1e7, 1e7), None]
    qs = box(40) + [(0.0, 0.0, 1e9, 1e9), (1e12, -1e12, -1e12, 1e12), (-inf, -inf, inf, inf), (nan, 0.0, 50.0, 50.0)]
    b = spark.createDataFrame([("d", i, 0, "x", x, None) for i, x in enumerate(bs)], BLOCKS)
    q = spark.createDataFrame([("d", i, x) for i, x in enumerate(qs)], "doc_id string, query_id int, query struct<top: double, left: double, bottom: double, right: double>")
    fine = [i for i, x in enumerate(bs) if x and all(abs(v) < inf for v in x)]
    for overlap in (0.0, 0.3, 1.0):
        got = [(x.query_id, x.block_id) for x in search.search_join(b, q, overlap).collect()]
        want = {(i, k) for i, x in enumerate(qs) if x[0] == x[0] for k in fine if (y := Rectangle(*bs[k])).area > 0 and y.overlap_percentage(Rectangle(*x)) * y.area >= y.area * search.clamped_share(overlap) and y.overlaps(Rectangle(*x))}
        assert len(got) == len(want) and set(got) == want
    assert {x.block_id for x in search.search(b, Rectangle(100, 100, 200, 200)).collect()} <= set(fine)


def test_one_dialect(spark):
    """search and split take the same patterns: properties, named groups, end anchors, ASCII classes."""
    b = blocks(spark, [(0, "Ünit7", 0, 0, 10, 50)], chars=True)
    for pattern, parts in ((r"\p{L}+", ["Ünit", "7"]), (r"(?<n>\d)\z", ["Ünit", "7"]), ("[[:alpha:]]+", ["Ü", "nit", "7"]), (r"[[:digit:]x]$", ["Ünit", "7"]), ("[[:^alpha:]]", ["Ü", "nit7"]), ("ü(n)", ["Ü", "n", "it7"])):
        assert search.search_regex(b, pattern).count() >= 1
        assert [r.text for r in split.split(b, pattern).orderBy("block_id").collect()] == parts
    for bad in ("[[:letters:]]", "[a--b]", "[a~~b]", r"(?<n>a", "*"):
        for f in (lambda p: search.search_regex(b, p), lambda p: split.split(b, p)):
            with pytest.raises(PatternError):
                f(bad)


def merged(spark, rows, threshold=1.0, **rules):
    df = scope.scoped(blocks(spark, rows), Rectangle(-9, -9, 9999, 9999), 0.0, threshold, rules=scope.MergeRules(**rules))
    return [r.text for r in df.orderBy("block_id").collect()]


def test_merge_rules(spark):
    two = [(0, "-7.25", 3, 2, 12, 31), (0, "8,001", 3, 31.8, 12, 55)]
    assert merged(spark, two) == ["-7.25 8,001"]
    assert merged(spark, two, no_numeric_pair_merge=True) == ["-7.25", "8,001"]
    dates = [(0, "11/30/19", 3, 2, 12, 31), (0, "12/24/19", 3, 31.4, 12, 60)]
    assert len(merged(spark, dates, no_date_pair_merge=True)) == 2
    assert merged(spark, [(0, "#", 3, 2, 12, 6), (0, "77.5", 3, 6.9, 12, 25)], no_numeric_pair_merge=True) == ["# 77.5"]
    chain = [(0, "12", 3, 2, 12, 14), (0, "crates", 3, 14.6, 12, 40), (0, "95", 3, 40.9, 12, 52)]
    assert merged(spark, chain, no_numeric_pair_merge=True) == ["12 crates 95"]
    assert merged(spark, [(0, "a", 0, 0, 10, 5), (1, "b", 0, 5, 10, 9)]) == ["a", "b"]
    assert merged(spark, [(0, "a", 0, 0, 10, 5), (0, "b", 20, 5, 30, 9)]) == ["a", "b"]
    assert merged(spark, two, threshold=0.0) == ["-7.25", "8,001"]


def test_normalize_uses_first_block_as_anchor(spark):
    rows = [(0, "a", 0, 0, 10, 5), (0, "b", 4, 10, 14, 15), (0, "c", 8, 20, 18, 25)]
    got = {r.text: (r.bbox.top, r.bbox.bottom) for r in scope.scoped(blocks(spark, rows), Rectangle(-1, -1, 99, 99), normalize=True).collect()}
    assert got == {"a": (2, 12), "b": (2, 12), "c": (8, 18)}


def test_split(spark):
    b = blocks(spark, [(0, "Total:42", 0, 0, 10, 80), (0, "plain", 20, 0, 30, 50), (0, "a b", 40, 0, 50, 30)], chars=True)
    out = split.split(b, r":(\d+)").orderBy("block_id").collect()
    assert [r.text for r in out] == ["Total:", "42", "plain", "a b"]
    assert (out[1].bbox.left, out[1].bbox.right) == (60, 80) and len(out[1].chars) == 2
    assert [r.text for r in split.split(b, "l", Rectangle(15, 0, 35, 60)).orderBy("block_id").collect()] == ["Total:42", "p", "l", "ain", "a b"]
    assert [r.text for r in split.split(b, " b").orderBy("block_id").collect()][-2:] == ["a", " b"]
    with pytest.raises(split.SplitError):
        split.split(b.drop("chars"), "a")
    with pytest.raises(PatternError):
        split.split(b, "(")


def test_page_rects(spark):
    b = blocks(spark, [(0, "a", 5, 1, 9, 4), (2, "b", 30, 0, 40, 8), (0, "c", 1, 2, 3, 9)])
    rects = {r.page_index: tuple(r.rect) for r in layout.infer_page_rects(b).collect()}
    assert rects == {0: (1, 1, 9, 9), 1: (0, 0, 0, 0), 2: (30, 0, 40, 8)}
    index = LayoutIndex.from_blocks(b)
    assert tuple(index.doc_rects.first().rect) == (1, 0, 40, 9)
    assert index.block_count().first()["count"] == 3
    assert index.scoped(Rectangle(0, 0, 10, 10)).split.__self__.page_rects.count() == 3


def test_segmentation_rules(spark):
    def words(glyphs):
        rows = [("d", g[0], i, g[1], (float(g[3]), float(g[2]), float(g[3] + g[4]), float(g[2] + 6)), g[5]) for i, g in enumerate(glyphs)]
        df = spark.createDataFrame(rows, "doc_id string, page_index int, seq long, ch string, bbox struct<top: double, left: double, bottom: double, right: double>, font_size double")
        return [r.text for r in segment.segment(df).orderBy("block_id").collect()]

    g = lambda ch, x, y=0, h=10, page=0, size=10.0: (page, ch, x, y, h, size)
    assert words([g("a", 0), g("b", 6), g(" ", 12), g("c", 18)]) == ["ab", "c"]
    assert words([g("a", 0), g("b", 8)]) == ["a", "b"]  # a gap of 2 at height 10
    assert words([g("a", 0), g("b", 6.9)]) == ["ab"]
    assert words([g("a", 0), g("B", 6.9)]) == ["a", "B"]  # lower to upper case over a gap
    assert words([g("a", 0), g("b", 6, y=6)]) == ["a", "b"]
    assert words([g("a", 0), g("b", 6, h=14)]) == ["a", "b"]
    assert words([g("a", 0), g("b", 6, size=11.0)]) == ["a", "b"]
    assert words([g("a", 0), g("b", 6, page=1)]) == ["a", "b"]
    assert words([g("-", 0), g("-", 6), g("-", 12)]) == []
    assert words([g("-", 0), g("-", 6)]) == ["--"]
    assert words([]) == []


def test_results_do_not_depend_on_partitions(spark):
    r = random.Random(9)
    rows = [(p, "".join(r.choice("ab ") for _ in range(3)).strip() or "c", 14 * k, 10 * r.randrange(9), 14 * k + 10, 100) for p in range(3) for k in range(9)]
    b = blocks(spark, rows)
    for f in (reading.text, lambda x: search.search_regex(x, "a+b?"), lambda x: scope.scoped(x, Rectangle(0, 0, 90, 90), 0.2, 4.0, True)):
        one, many = f(b.coalesce(1)), f(b.repartition(7, "block_id"))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert b.select(F.count("*")).first()[0] == len(rows)
