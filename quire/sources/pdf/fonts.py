"""Fonts: how the bytes of a string become characters, and how wide and tall those are."""

from __future__ import annotations

import struct

from .document import Document
from .lexer import END, Lexer, Name, Ref, Stream, Word
from .metrics import VERTICAL, character, standard_font, standard_widths

# Limits of a believable Type 3 box, the box taken otherwise, and the least unit (fixed values).
TYPE3_LEAST, TYPE3_MOST, TYPE3_HEIGHT, TINY = 0.2, 3.0, 1.0, 1e-9
# Differences are honoured for the names of spaces only (fixed values).
SPACES = ("space", "nbspace", "nonbreakingspace", "uni00A0", "uni0020")


class CMap:
    """Code spaces and mappings to text."""

    def __init__(self, data: bytes):
        self.spaces: list[tuple[int, int, int]] = []
        self.text: dict[tuple[int, int], str] = {}
        lexer, held = Lexer(data), []
        while (t := lexer.value(refs=False)) is not END:
            if not isinstance(t, Word):
                held.append(t)
                continue
            if t == b"endcodespacerange":
                for a, b in zip(held[::2], held[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.spaces.append((len(a), _int(a), _int(b)))
            elif t == b"endbfchar":
                for a, b in zip(held[::2], held[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.text[len(a), _int(a)] = _utf16(b)
            elif t == b"endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self._range(a, b, c)
            held = []

    def _range(self, a: bytes, b: bytes, to) -> None:
        lo, hi = _int(a), min(_int(b), _int(a) + 0xFFFF)
        if isinstance(to, list):
            for i, x in enumerate(to[: hi - lo + 1]):
                if isinstance(x, bytes):
                    self.text[len(a), lo + i] = _utf16(x)
        elif isinstance(to, bytes) and to:
            for i in range(hi - lo + 1):
                self.text[len(a), lo + i] = _utf16((_int(to) + i).to_bytes(max(len(to), 1) + 1, "big")[-len(to) :])

    def codes(self, data: bytes):
        """(length, code) of each code: the shortest of 1 to 4 bytes that lies in a code space, else one byte."""
        i, spaces = 0, self.spaces or [(1, 0, 255)]
        while i < len(data):
            for n in range(1, 5):
                code = _int(data[i : i + n])
                if i + n <= len(data) and any(s == n and a <= code <= b for s, a, b in spaces):
                    break
            else:
                n, code = 1, data[i]
            yield n, code
            i += n


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _utf16(b: bytes) -> str:
    return (b if len(b) != 1 else b"\0" + b).decode("utf-16-be", "replace").replace("�", "")


class Font:
    def __init__(self, doc: Document, d: dict):
        deep = doc.deep
        self.name = deep(d.get("BaseFont"))
        self.name = str(self.name) if isinstance(self.name, Name) else None
        number = lambda v, default: float(x) if isinstance(x := deep(v), (int, float)) else default
        self.first = int(number(d.get("FirstChar"), 0))
        widths = deep(d.get("Widths"))
        self.widths = [number(w, 0.0) for w in widths] if isinstance(widths, list) else []
        matrix = deep(d.get("FontMatrix"))
        self.unit = number(matrix[0], 0.001) if isinstance(matrix, list) and matrix else 0.001
        tall = number(matrix[3], self.unit) if isinstance(matrix, list) and len(matrix) > 3 else self.unit
        desc = deep(d.get("FontDescriptor"))
        has_desc = isinstance(desc, dict)
        self.ascent = number(desc.get("Ascent"), 800.0) if has_desc else 800.0
        self.descent = number(desc.get("Descent"), -200.0) if has_desc else -200.0
        cmap = doc.decode(d.get("ToUnicode")) if "ToUnicode" in d else None
        self.to_unicode = CMap(cmap) if cmap is not None else None
        kind = deep(d.get("Subtype"))
        if kind == "Type3" and not has_desc and (box := doc.box(d.get("FontBBox"))):
            self._type3(box, tall)
        self.codec, self.spaces = "cp1252", set()
        self.two_bytes, self.encoding = False, None
        self.cids: dict[int, float] = {}
        self.cid_width = 1000.0
        source = d
        if kind == "Type0":
            below = deep(d.get("DescendantFonts"))
            below = deep(below[0]) if isinstance(below, list) and below else below
            source = below if isinstance(below, dict) else d
            enc = deep(d.get("Encoding"))
            self.two_bytes = enc in ("Identity-H", "Identity-V")
            if isinstance(enc, Stream) and (data := doc.decode(enc)) is not None:
                self.encoding = CMap(data)
            if source is not d:
                self.cid_width = float(round(number(source.get("DW"), 1000.0)))
                self._cid_widths(doc, deep(source.get("W")))
        else:
            self._single(doc, deep(d.get("Encoding")))
        self.composite = self.two_bytes or self.encoding is not None
        if self.cids:
            self.unit = 0.001
        standard = standard_font(self.name)
        if not self.widths and not self.cids and (ttf := _truetype(doc, source)):
            self.widths, self.ascent, self.descent, self.unit = ttf
            self.first = 0
        file_keys = deep(source.get("FontDescriptor"))
        embedded = isinstance(file_keys, dict) and any(k in file_keys for k in ("FontFile", "FontFile2", "FontFile3"))
        if standard and not embedded and standard[0] != "Helvetica":
            self.ascent, self.descent = VERTICAL[standard[0]]
            self.unit = 0.001
            if not any(w > 0 for w in self.widths) and not self.cids:
                self.widths = []
        if standard and not self.widths and not self.cids:
            self.widths, self.first = list(standard_widths(standard[1], self.codec)), 0

    def _type3(self, box, tall: float) -> None:
        scale = abs(tall) if abs(tall) > TINY else abs(self.unit)
        if TYPE3_LEAST <= (box[3] - box[1]) * scale <= TYPE3_MOST:
            self.ascent, self.descent = box[3], box[1]
        else:
            half = TYPE3_HEIGHT / 2 / max(abs(self.unit), TINY)
            self.ascent, self.descent = (box[1] + box[3]) / 2 + half, (box[1] + box[3]) / 2 - half

    def _single(self, doc: Document, enc) -> None:
        base = doc.deep(enc.get("BaseEncoding")) if isinstance(enc, dict) else enc
        if base == "MacRomanEncoding":
            self.codec = "mac_roman"
        code = 0
        for x in (doc.deep(enc.get("Differences")) or []) if isinstance(enc, dict) else []:
            x = doc.deep(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if x in SPACES:
                    self.spaces.add(code)
                code += 1

    def _cid_widths(self, doc: Document, w) -> None:
        items = [doc.deep(x) for x in w] if isinstance(w, list) else []
        i = 0
        while i + 1 < len(items):
            a, b = items[i], items[i + 1]
            if isinstance(b, list) and not isinstance(b, Ref):
                for k, x in enumerate(b):
                    x = doc.deep(x)
                    self.cids.setdefault(int(a) + k, float(round(x)) if isinstance(x, (int, float)) else 0.0)
                i += 2
            elif i + 2 < len(items) and all(isinstance(x, (int, float)) for x in (a, b, items[i + 2])):
                for k in range(int(a), min(int(b), int(a) + 0xFFFF) + 1):
                    self.cids.setdefault(k, float(round(items[i + 2])))
                i += 3
            else:
                i += 1

    def glyphs(self, data: bytes):
        """(width in text space at size 1, text) of each code."""
        if self.two_bytes:
            codes = ((2, _int(data[i : i + 2])) for i in range(0, len(data) - 1, 2))
        elif self.encoding is not None:
            codes = self.encoding.codes(data)
        elif self.to_unicode is not None and self.to_unicode.spaces:
            codes = self.to_unicode.codes(data)
        else:
            codes = ((1, b) for b in data)
        for n, code in codes:
            yield self._width(code) * self.unit, self._text(n, code)

    def _width(self, code: int) -> float:
        if code <= 0xFF:
            at = code - self.first
            w = self.widths[at] if 0 <= at < len(self.widths) else 0.0
            if w or not self.composite:
                return w
        return self.cids.get(code, self.cid_width)

    def _text(self, n: int, code: int) -> str:
        for cmap in (self.to_unicode, self.encoding):
            if cmap is not None:
                # a mapping may be stated for another length of the same code
                for size in (n, 1, 2):
                    if (t := cmap.text.get((size, code))) is not None:
                        return t
        if self.composite:
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""
        return " " if code in self.spaces else character(code & 0xFF, self.codec)


def _truetype(doc: Document, source: dict) -> tuple[list[float], float, float, float] | None:
    """(widths of the 256 Windows codes, ascent, descent, unit) of an embedded TrueType file."""
    desc = doc.deep(source.get("FontDescriptor"))
    data = doc.decode(desc["FontFile2"]) if isinstance(desc, dict) and "FontFile2" in desc else None
    if not data:
        return None
    try:
        count = struct.unpack_from(">H", data, 4)[0]
        at = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">I", data, 20 + 16 * i)[0] for i in range(count)}
        units = struct.unpack_from(">H", data, at[b"head"] + 18)[0]
        ascent, descent = struct.unpack_from(">hh", data, at[b"hhea"] + 4)
        n = struct.unpack_from(">H", data, at[b"hhea"] + 34)[0]
        glyph = _character_map(data, at[b"cmap"])
        width = lambda g: float(struct.unpack_from(">H", data, at[b"hmtx"] + 4 * min(g, n - 1))[0])
        return [width(glyph(ord(character(c, "cp1252")))) for c in range(256)], float(ascent), float(descent), 1.0 / units
    except (KeyError, struct.error, ZeroDivisionError):
        return None


def _character_map(data: bytes, base: int):
    """Character code to glyph number, from a table of format 4, or 0 otherwise."""
    tables = {}
    for i in range(struct.unpack_from(">H", data, base + 2)[0]):
        platform, kind, off = struct.unpack_from(">HHI", data, base + 4 + 8 * i)
        tables[struct.unpack_from(">H", data, base + off)[0], platform, kind] = base + off
    four = next((v for k, v in sorted(tables.items(), reverse=True) if k[0] == 4), None)
    if four is not None:
        segments = struct.unpack_from(">H", data, four + 6)[0] // 2
        read = lambda off: struct.unpack_from(f">{segments}H", data, four + off)
        ends, starts, deltas, offsets = read(14), read(16 + 2 * segments), read(16 + 4 * segments), read(16 + 6 * segments)

        def find(c: int) -> int:
            for i, end in enumerate(ends):
                if c <= end:
                    if c < starts[i]:
                        return 0
                    if not offsets[i]:
                        return (c + deltas[i]) & 0xFFFF
                    place = four + 16 + 6 * segments + 2 * i + offsets[i] + 2 * (c - starts[i])
                    g = struct.unpack_from(">H", data, place)[0]
                    return (g + deltas[i]) & 0xFFFF if g else 0
            return 0

        return find
    zero = next((v for k, v in tables.items() if k[0] == 0), None)
    return lambda c: data[zero + 6 + c] if zero is not None and c < 256 else 0
