"""Metrics of the fourteen standard fonts.

Advance widths of the characters 32 to 126 come from the public AFM files. An
accented letter is as wide as its base letter there, so other characters take the
width of their decomposition's first character, or that of "n".
"""

from __future__ import annotations

import functools
import unicodedata

# Fixed values, in thousandths of the font size, from space to tilde.
WIDTHS = {
    "Helvetica": """278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
        1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
        333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584""",
    "Helvetica-Bold": """278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611
        975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556
        333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584""",
    "Times-Roman": """250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444
        921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500
        333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541""",
    "Times-Bold": """250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500
        930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500
        333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520""",
    "Times-Italic": """250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500
        920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500
        333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541""",
    "Times-BoldItalic": """250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500
        832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500
        333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570""",
}
# (ascent, descent) by family, and the one width of the families that have one (fixed values).
VERTICAL = {"Helvetica": (718.0, -207.0), "Courier": (629.0, -157.0), "Times": (683.0, -217.0), "Symbol": (700.0, -200.0), "ZapfDingbats": (700.0, -200.0)}
EVEN = {"Courier": 600.0, "Symbol": 500.0, "ZapfDingbats": 500.0}
# Other names of the families (fixed values).
FAMILIES = {
    "Helvetica": "Helvetica", "Arial": "Helvetica", "ArialMT": "Helvetica",
    "Courier": "Courier", "CourierNew": "Courier", "CourierNewPS": "Courier", "CourierNewPSMT": "Courier",
    "Times": "Times", "TimesNewRoman": "Times", "TimesNewRomanPS": "Times", "TimesNewRomanPSMT": "Times",
    "Symbol": "Symbol", "ZapfDingbats": "ZapfDingbats",
}


def standard_font(name: str | None) -> tuple[str, str] | None:
    """(family, name of its widths) of a base font name, which may have a subset prefix and a style."""
    if not name:
        return None
    if len(name) > 7 and name[6] == "+" and name[:6].isalpha() and name[:6].isupper():
        name = name[7:]
    plain, _, style = name.replace(" ", "").replace(",", "-").partition("-")
    family = FAMILIES.get(plain)
    if family is None:
        return None
    style = style.lower().removesuffix("mt")
    if style not in ("", "roman", "regular", "bold", "italic", "oblique", "bolditalic", "boldoblique"):
        return None
    bold, slanted = "bold" in style, "italic" in style or "oblique" in style
    if family == "Helvetica":
        return family, "Helvetica-Bold" if bold else "Helvetica"
    if family == "Times":
        return family, {(0, 0): "Times-Roman", (1, 0): "Times-Bold", (0, 1): "Times-Italic", (1, 1): "Times-BoldItalic"}[bold, slanted]
    return family, family


@functools.cache
def standard_widths(which: str, codec: str) -> tuple[float, ...]:
    """The widths of 256 codes."""
    if which in EVEN:
        return (EVEN[which],) * 256
    row = [float(x) for x in WIDTHS[which].split()]

    def width(code: int) -> float:
        ch = character(code, codec)
        base = unicodedata.normalize("NFKD", ch)[:1] if ch else ""
        at = ord(base) - 32 if base else -1
        return row[at] if 0 <= at < 95 else row[ord("n") - 32]

    return tuple(width(c) for c in range(256))


@functools.cache
def character(code: int, codec: str) -> str:
    """The character of a code; codes that the encoding leaves open stand for themselves."""
    try:
        return bytes([code]).decode(codec)
    except UnicodeDecodeError:
        return chr(code)
