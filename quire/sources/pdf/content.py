"""The content interpreter: which characters a page shows, and where."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .document import Document, compose
from .fonts import Font
from .lexer import END, Lexer, Name, Stream, Word

# Limits of visibility (fixed values): least contrast with the ground, least part of a clipped glyph, fills kept track of, forms inside forms.
LEAST_CONTRAST, LEAST_PART, MOST_FILLS, MOST_FORMS = 1.05, 0.25, 4096, 24
TINY_AREA = 1e-9
IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
_FILLS = (b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*")
# Operators, among which an inline image may end.
_OPERATORS = frozenset(b"b B b* B* BDC BI BMC BT BX c cm CS cs d d0 d1 Do DP EI EMC ET EX f F f* G g gs h i ID j J K k l m M MP n q Q re RG rg ri s S SC sc SCN scn sh T* Tc Td TD Tf Tj TJ TL Tm Tr Ts Tw Tz v w W W* y ' \"".split())
_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)")
_LOOSE_END = re.compile(rb"EI")


def linear(c: float) -> float:
    c = min(max(c, 0.0), 1.0)
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def luminance(rgb) -> float:
    return 0.2126 * linear(rgb[0]) + 0.7152 * linear(rgb[1]) + 0.0722 * linear(rgb[2])


def contrast(a: float, b: float) -> float:
    return (max(a, b) + 0.05) / (min(a, b) + 0.05)


@dataclass
class State:
    """Text and colour state, saved and restored with the graphics state."""

    font: Font | None = None
    size: float = 0.0
    spacing: float = 0.0
    word: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    space: str = "Gray"
    rgb: tuple | None = (0.0, 0.0, 0.0)
    fill_alpha: float | None = None
    stroke_alpha: float | None = None

    def paints(self) -> bool:
        mode = self.mode % 8
        if mode in (0, 2, 4, 6) and not (self.fill_alpha is not None and self.fill_alpha <= 0):
            return True
        return mode in (1, 2, 5, 6) and not (self.stroke_alpha is not None and self.stroke_alpha <= 0)


def _meet(a, b):
    return b if a is None else (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))


def _touch(a, b) -> bool:
    return a[2] >= b[0] and b[2] >= a[0] and a[3] >= b[1] and b[3] >= a[1]


def _area(r) -> float:
    return max(r[2] - r[0], 0.0) * max(r[3] - r[1], 0.0)


def _around(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return (min(xs), min(ys), max(xs), max(ys))


def _apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class Interpreter:
    """Runs the streams of one page; emit(character, box, state) is called for each visible character."""

    def __init__(self, doc: Document, emit):
        self.doc, self.emit = doc, emit
        self.fonts: dict[int, Font | None] = {}

    def run(self, data: bytes, resources, ctm: list[float] | None = None, clip=None) -> None:
        """One content stream of the page, with its own record of painted fills."""
        self.fills: list[tuple] = []
        self._run(data, resources, ctm or IDENTITY, State(), clip, [], 0, IDENTITY, IDENTITY)

    def _resource(self, resources, kind: str, name):
        r = self.doc.deep(resources)
        d = self.doc.deep(r.get(kind)) if isinstance(r, dict) else None
        return self.doc.deep(d.get(name)) if isinstance(d, dict) else None

    def _font(self, resources, name) -> Font | None:
        d = self._resource(resources, "Font", name)
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            self.fonts[id(d)] = Font(self.doc, d)
        return self.fonts[id(d)]

    def _run(self, data: bytes, resources, ctm, st: State, clip, marks: list[str], depth: int, tm, line) -> None:
        """One stream; the text matrices tm and line are part of the graphics state that q saves and forms inherit."""
        lexer, ops, saved = Lexer(data), [], []
        st = replace(st)
        box, points = None, []
        marks = list(marks)

        def num(i: int) -> float:
            v = ops[i] if -len(ops) <= i < len(ops) else 0
            return float(v) if isinstance(v, (int, float)) else 0.0

        while (t := lexer.value(refs=False)) is not END:
            if not isinstance(t, Word):
                ops.append(t)
                continue
            n = len(ops)
            match bytes(t):
                case b"q":
                    saved.append((ctm, replace(st), clip, tm, line))
                case b"Q" if saved:
                    ctm, st, clip, tm, line = saved.pop()
                case b"cm" if n == 6:
                    ctm = compose(ctm, [num(i) for i in range(6)])
                case b"m" if n == 2:
                    points = [_apply(ctm, num(0), num(1))]
                case b"l" if n == 2:
                    points.append(_apply(ctm, num(0), num(1)))
                case b"re" if n == 4:
                    x, y, w, h = (num(i) for i in range(4))
                    box, points = _around([_apply(ctm, a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]), []
                case b"W" | b"W*":
                    if path := box or (points and _around(points)):
                        clip = _meet(clip, path)
                case op if op in _FILLS:
                    self._painted(box or (points and _around(points)), clip, st)
                    box, points = None, []
                case b"n" | b"S" | b"s":
                    box, points = None, []
                case b"gs" if n:
                    self._external(self._resource(resources, "ExtGState", ops[0]), st)
                case b"cs" if n:
                    st.space = self._space(resources, ops[-1])
                case b"g" | b"rg" | b"k" | b"sc" | b"scn" as op:
                    self._colour(op, [v for v in ops if isinstance(v, (int, float))], st)
                case b"BMC" | b"BDC":
                    tagged = isinstance(ops[1], dict) and "MCID" in ops[1] if n > 1 else False
                    marks.append("artifact" if n and ops[0] == "Artifact" else "tagged" if tagged or (n > 1 and isinstance(ops[1], Name)) else "other")
                case b"EMC" if marks:
                    marks.pop()
                case b"Do" if n:
                    x = self._resource(resources, "XObject", ops[0])
                    if isinstance(x, Stream) and self.doc.deep(x.dict.get("Subtype")) == "Form" and depth < MOST_FORMS:
                        own = self.doc.numbers(x.dict.get("Matrix"), 6) or IDENTITY
                        if (form := self.doc.decode(x)) is not None:
                            self._run(form, x.dict.get("Resources", resources), compose(ctm, own), st, clip, marks, depth + 1, tm, line)
                case b"BT":
                    tm = line = list(IDENTITY)
                case b"Tf" if n >= 2:
                    st.font, st.size = self._font(resources, ops[-2]), num(-1)
                case b"Tm" if n == 6:
                    tm = line = [num(i) for i in range(6)]
                case (b"Td" | b"TD") as op if n == 2:
                    if op == b"TD":
                        st.leading = -num(1)
                    tm = line = compose(line, [1.0, 0.0, 0.0, 1.0, num(0), num(1)])
                case b"T*":
                    tm = line = compose(line, [1.0, 0.0, 0.0, 1.0, 0.0, -st.leading])
                case b"TL" if n:
                    st.leading = num(0)
                case b"Tc" if n:
                    st.spacing = num(0)
                case b"Tw" if n:
                    st.word = num(0)
                case b"Tz" if n:
                    st.scale = num(0)
                case b"Ts" if n:
                    st.rise = num(0)
                case b"Tr" if n:
                    st.mode = int(num(0))
                case b"Tj" | b"TJ" | b"'" | b'"' as op if n:
                    if op in (b"'", b'"'):
                        if op == b'"' and n >= 3:
                            st.word, st.spacing = num(0), num(1)
                        tm = line = compose(line, [1.0, 0.0, 0.0, 1.0, 0.0, -st.leading])
                    for item in ops[-1] if isinstance(ops[-1], list) else [ops[-1]]:
                        if isinstance(item, bytes):
                            tm = self._show(item, st, tm, ctm, clip, marks)
                        elif isinstance(item, (int, float)):
                            tm = _advanced(tm, -item / 1000 * st.size * st.scale / 100)
                case b"ID":
                    lexer.pos = _image_end(data, lexer.pos)
            ops = []

    def _external(self, d, st: State) -> None:
        if not isinstance(d, dict):
            return
        mode = next((d[k] for k in ("Tr", "TR", "TR2") if k in d), None)
        if isinstance(mode, int):
            st.mode = mode
        for key, name in (("ca", "fill_alpha"), ("CA", "stroke_alpha")):
            v = self.doc.deep(d.get(key))
            if isinstance(v, (int, float)):
                setattr(st, name, float(v))

    def _space(self, resources, name) -> str:
        known = {"DeviceGray": "Gray", "G": "Gray", "CalGray": "Gray", "DeviceRGB": "RGB", "RGB": "RGB", "CalRGB": "RGB", "DeviceCMYK": "CMYK", "CMYK": "CMYK"}
        if name in known:
            return known[name]
        d = self._resource(resources, "ColorSpace", name)
        if isinstance(d, Name):
            return known.get(d, "Unknown")
        if isinstance(d, list) and d:
            kind = self.doc.deep(d[0])
            if kind == "ICCBased" and len(d) > 1 and isinstance(s := self.doc.deep(d[1]), Stream):
                return {1: "Gray", 3: "RGB", 4: "CMYK"}.get(self.doc.deep(s.dict.get("N")), "Unknown")
            return known.get(kind, "Unknown")
        return "Unknown"

    def _colour(self, op: bytes, v: list, st: State) -> None:
        space = {b"g": "Gray", b"rg": "RGB", b"k": "CMYK"}.get(op) or st.space
        v = [min(max(float(x), 0.0), 1.0) for x in v]
        if space == "Gray" and len(v) == 1:
            st.rgb = (v[0],) * 3
        elif space == "RGB" and len(v) == 3:
            st.rgb = tuple(v)
        elif space == "CMYK" and len(v) == 4:
            st.rgb = tuple(1.0 - min(x + v[3], 1.0) for x in v[:3])

    def _painted(self, box, clip, st: State) -> None:
        alpha = 1.0 if st.fill_alpha is None else st.fill_alpha
        if not box or alpha <= 0 or len(self.fills) >= MOST_FILLS:
            return
        box = _meet(clip, box)
        if box[0] < box[2] and box[1] < box[3]:
            # blended with white
            ground = luminance([c * alpha + 1 - alpha for c in st.rgb]) if st.rgb else None
            self.fills.append((box, ground))

    def _shows(self, box, st: State, text_luminance: float) -> bool:
        return any(g is None or contrast(text_luminance, g) >= LEAST_CONTRAST for f, g in self.fills if _touch(f, box))

    def _show(self, data: bytes, st: State, tm, ctm, clip, marks: list[str]):
        font = st.font
        hidden_but_tagged = st.mode % 8 in (3, 7) and "tagged" in marks and "artifact" not in marks
        if font is None or not (hidden_but_tagged or st.paints()):
            return tm
        filled = st.mode % 8 in (0, 2, 4, 6) and not (st.fill_alpha is not None and st.fill_alpha <= 0)
        lum = luminance(st.rgb) if st.rgb else 0.0
        doubtful = filled and st.rgb is not None and self.fills and contrast(lum, 1.0) < LEAST_CONTRAST
        shape = [st.size * st.scale / 100, 0.0, 0.0, st.size, 0.0, st.rise]
        low, high = font.descent * font.unit, font.ascent * font.unit
        # glyphs differ in their place along one line only: the matrix is composed once a string
        m = compose(ctm, compose(tm, shape))
        dx, dy = ctm[0] * tm[0] + ctm[2] * tm[1], ctm[1] * tm[0] + ctm[3] * tm[1]
        upright = m[1] == 0 and m[2] == 0
        bottom, top = sorted((m[3] * low, m[3] * high))
        gone = 0.0
        for width, text in font.glyphs(data):
            step = (width * st.size + (st.word if " " in text else 0.0) + st.spacing) * st.scale / 100
            n = len(text)
            if not n:
                gone += step
                continue
            for ch in text:
                x, y = m[4] + dx * gone, m[5] + dy * gone
                if upright:
                    x2 = x + m[0] * width / n
                    raw = (x, y + bottom, x2, y + top) if x <= x2 else (x2, y + bottom, x, y + top)
                else:
                    at = [*m[:4], x, y]
                    raw = _around([_apply(at, u, v) for u in (0.0, width / n) for v in (low, high)])
                gone += step / n
                seen = raw
                if clip is not None:
                    if not _touch(clip, raw):
                        continue
                    seen = _meet(clip, raw)
                    if not (hidden_but_tagged or seen == raw or _area(raw) <= TINY_AREA or _area(seen) / _area(raw) >= LEAST_PART):
                        continue
                if not doubtful or self._shows(seen, st, lum):
                    self.emit(ch, seen, st)
        return _advanced(tm, gone)


def _advanced(tm, by: float):
    return [*tm[:4], tm[4] + tm[0] * by, tm[5] + tm[1] * by]


def _image_end(data: bytes, pos: int) -> int:
    """The place after an inline image: at an EI between white space, else at one that an operator follows soon, else the end."""
    if m := _IMAGE_END.search(data, pos):
        return m.end()
    for m in _LOOSE_END.finditer(data, pos):
        lexer = Lexer(data, m.end())
        for _ in range(8):
            t = lexer.value(refs=False)
            if t is END:
                break
            if isinstance(t, Word):
                if bytes(t) in _OPERATORS:
                    return m.end()
                break
    return len(data)
