"""Fill colours: column expressions for conversion, luminance and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def srgb_to_linear(c: Column) -> Column:
    u = unit(c)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour."""
    return srgb_to_linear(r) * 0.2126 + srgb_to_linear(g) * 0.7152 + srgb_to_linear(b) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    """Contrast of two luminances: at least 1."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct(r, g, b)."""
    return F.struct(*((1.0 - F.least(unit(x) + unit(k), F.lit(1.0))).alias(n) for n, x in zip("rgb", (c, m, y))))
