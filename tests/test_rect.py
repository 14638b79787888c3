import random

import pytest
from pyspark.sql import functions as F

from quire.functions import color, expand, tokens
from quire.functions import rect as R


def rects(n, seed=3):
    r = random.Random(seed)
    return [R.Rectangle(*(float(r.randrange(0, 12)) for _ in range(4))) for _ in range(n)]


def test_columns_agree_with_values(spark):
    pairs = list(zip(rects(300), rects(300, 4)))
    df = spark.createDataFrame([(i, tuple(vars(a).values()), tuple(vars(b).values())) for i, (a, b) in enumerate(pairs)], "i int, a struct<top: double, left: double, bottom: double, right: double>, b struct<top: double, left: double, bottom: double, right: double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        "i", R.overlap_percentage(a, b), R.overlaps(a, b, 0.2), R.overlaps_horizontally(a, b), R.contains_left_side(a, b), R.vertical_overlap(a, b, 0.5),
        R.distance(a, b), R.is_valid(a), R.overlaps_with_margins(a, b, 1, 2, 0, 1), R.with_margin(a, 1, 2, 3, 4),
    ).orderBy("i").collect()
    for row, (x, y) in zip(got, pairs):
        assert row[1] == pytest.approx(x.overlap_percentage(y))
        assert row[2] == x.overlaps(y, 0.2)
        assert row[3] == x.overlaps_horizontally(y)
        assert row[4] == x.contains_left_side(y)
        assert row[5] == x.vertical_overlap(y, 0.5)
        assert row[6] == pytest.approx(x.distance(y))
        assert row[7] == x.validate()
        assert row[8] == x.overlaps_with_margins(y, 1, 2, 0, 1)
        assert R.Rectangle.of(row[9]) == x.with_margin(top=1, bottom=2, left=3, right=4)


def test_values_of_blocks():
    box, other = R.Rectangle(1, 2, 3, 4), R.Rectangle(1, 2, 3, 5)
    row = {"bbox": {"top": 1, "left": 2, "bottom": 3, "right": 4}, "text": "a", "chars": [{"ch": "a", "bbox": {"top": 1, "left": 2, "bottom": 3, "right": 4}}]}
    block = R.TextBlock.of(row)
    assert block == R.TextBlock(box, "a") and block.chars == (R.TextChar(box, "a"),) and R.TextChar(box, "a") != R.TextChar(other, "a")
    assert block != R.TextBlock(other, "a") and block != R.TextBlock(box, "b") and R.TextBlock.of({"bbox": row["bbox"], "text": "a"}).chars == ()


def test_corner_names():
    r = R.Rectangle(1, 2, 3, 4)
    assert r.corner("right", "top") == R.Point(4, 1)
    assert R.Point(0, 0).distance(R.Point(3, 4)) == 5
    with pytest.raises(ValueError):
        r.corner("middle", "top")
    assert r.with_top(9).top == 9 and r.with_coords(left=None, right=7).right == 7


def test_expand_single_axis_and_errors():
    base, bounds = R.Rectangle(31, 12, 44, 25), R.Rectangle(0, 0, 90, 120)
    assert expand.expand_rectangle(base, [R.Rectangle(40, 61, 48, 70), R.Rectangle(2, 50, 9, 55)], ["right"], bounds) == R.Rectangle(31, 12, 44, 61)
    with pytest.raises(expand.ExpandError):
        expand.expand_rectangle(base, [], [], bounds)
    with pytest.raises(ValueError):
        expand.expand_rectangle(base, [], ["sideways"], bounds)
    with pytest.raises(expand.ExpandError):
        expand.expand_rectangle(base, [], ["up"], R.Rectangle(33, 0, 100, 100))


def test_expand_never_meets_blockers_it_faces():
    base, bounds = R.Rectangle(40, 40, 50, 50), R.Rectangle(0, 0, 100, 100)
    for seed in range(60):
        r = random.Random(seed)
        blockers = []
        for _ in range(6):
            t, left = r.randrange(0, 90), r.randrange(0, 90)
            b = R.Rectangle(t, left, t + r.randrange(1, 10), left + r.randrange(1, 10))
            if not b.overlaps(base):
                blockers.append(b)
        for dirs in (["up"], ["left", "right"], ["up", "down"]):
            grown = expand.expand_rectangle(base, blockers, dirs, bounds)
            assert grown.top <= 40 and grown.left <= 40 and grown.bottom >= 50 and grown.right >= 50
            assert not any(b.overlaps(grown) for b in blockers)
        mixed = expand.expand_rectangle(base, blockers, ["up", "down", "left", "right"], bounds)
        assert mixed.area >= base.area and mixed.left >= 0 and mixed.right <= 100


def test_expand_columns_match_values(spark):
    base, bounds = R.Rectangle(40, 40, 50, 50), R.Rectangle(0, 0, 100, 100)
    blockers = [R.Rectangle(0, 60, 100, 70), R.Rectangle(45, 10, 46, 20), R.Rectangle(10, 41, 20, 45)]
    array = F.array(*(b.literal() for b in blockers))
    for dirs in (["left", "right"], ["up", "right"], ["up", "down", "left", "right"]):
        row = spark.range(1).select(expand.expand(base.literal(), array, dirs, bounds.literal()).alias("r")).first()
        assert R.Rectangle.of(row.r) == expand.expand_rectangle(base, blockers, dirs, bounds)
    outside = spark.range(1).select(expand.expand(base.literal(), array, ["up"], R.Rectangle(45, 0, 9, 9).literal()).alias("r")).first()
    assert outside.r is None


def test_token_classes(spark):
    numeric = ["1", "1,234", "-5", "$-3.50", "-$3", "(1,234.00)", ".5", "12.", "7-", "$1"]
    other = ["", "1,23", "abc", "$", "--1", "1.2.3", "1 2", "(", "$$1", "1\n"]
    dates = ["01/31/24", "1-2-2024", "(01/02/2024)", "01/31/24-02/01/24"]
    df = spark.createDataFrame([(t,) for t in numeric + other + dates], ["t"])
    rows = {r.t: (r.n, r.d) for r in df.select("t", tokens.is_numeric_token(F.col("t")).alias("n"), tokens.is_date_token(F.col("t")).alias("d")).collect()}
    assert all(rows[t][0] for t in numeric) and not any(rows[t][0] for t in other)
    assert all(rows[t][1] for t in dates) and not any(rows[t][1] for t in numeric + other)


def test_contrast(spark):
    one = F.lit(1.0)
    row = spark.range(1).select(color.luminance(one, one, one).alias("l"), color.contrast_ratio(F.lit(0.0), one).alias("c"), color.cmyk_to_rgb(one, F.lit(0.0), F.lit(0.25), F.lit(0.5)).alias("m")).first()
    assert row.l == pytest.approx(1) and row.c == pytest.approx(21) and tuple(row.m) == pytest.approx((0, 0.5, 0.25))
