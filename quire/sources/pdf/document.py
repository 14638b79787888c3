"""Objects of a PDF file, found by scanning the bytes: cross-reference tables are never read, so damaged ones do no harm."""

from __future__ import annotations

import re
import zlib

from .crypto import Security
from .lexer import END, Lexer, Name, Ref, Stream

_HEAD = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![a-zA-Z])|trailer")
# How near the end of a stream is looked for, and how deep references and page trees are followed (fixed values).
NEAR, DEPTH, PAGE_DEPTH = 256, 8, 200


class Document:
    def __init__(self, data: bytes, password: bytes | None = None):
        self.data = data
        self.objects: dict[tuple[int, int], object] = {}
        self.trailer: dict = {}
        self._heads: dict[int, list[int]] | None = None
        self._decoded: dict[int, bytes | None] = {}
        self._scan()
        self._decrypt(password or b"")
        self._unpack()

    def _scan(self) -> None:
        data, pos = self.data, 0
        while m := _HEAD.search(data, pos):
            lexer = Lexer(data, m.end())
            if m[0] == b"trailer":
                value = lexer.value()
                if isinstance(value, dict):
                    self.trailer = value
                pos = max(lexer.pos, m.end())
                continue
            value = lexer.value()
            pos = lexer.pos
            if isinstance(value, dict):
                back = lexer.pos
                if lexer.token() == b"stream":
                    value, pos = self._stream(value, lexer.pos)
                else:
                    lexer.pos = back
            self.objects[int(m[1]), int(m[2])] = value
            if isinstance(value, Stream) and value.dict.get("Type") == "XRef" and not self.trailer:
                self.trailer = value.dict
            # whatever else precedes the end of the object is skipped
            end, head = data.find(b"endobj", pos), _HEAD.search(data, pos)
            if end >= 0 and (head is None or end < head.start()):
                pos = end + 6

    def _stream(self, d: dict, pos: int) -> tuple[Stream, int]:
        data = self.data
        if data[pos : pos + 2] == b"\r\n":
            pos += 2
        elif data[pos : pos + 1] in (b"\n", b"\r"):
            pos += 1
        size = self._length(d.get("Length"))
        if size is not None and pos + size <= len(data):
            near = data[pos + size : pos + size + NEAR]
            a, b = near.find(b"endstream"), near.find(b"endobj")
            right = a >= 0 and not near[:a].strip(b"\x00\t\n\x0c\r ")
            if right or (b >= 0 and (a < 0 or b < a)):
                return Stream(d, data[pos : pos + size]), pos + size
        end = data.find(b"endstream", pos)
        end = len(data) if end < 0 else end
        body = data[pos:end]
        for tail in (b"\r\n", b"\n", b"\r"):
            if body.endswith(tail):
                body = body[: -len(tail)]
                break
        return Stream(d, body), end

    def _length(self, value) -> int | None:
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                break
            if tuple(value) in self.objects:
                value = self.objects[tuple(value)]
                continue
            if self._heads is None:
                self._heads = {}
                for m in _HEAD.finditer(self.data):
                    if m[1]:
                        self._heads.setdefault(int(m[1]), []).append(m.end())
            at = self._heads.get(value[0])
            value = Lexer(self.data, at[-1]).value() if at else None
        return value if isinstance(value, int) and value >= 0 else None

    def resolve(self, value):
        """One step of a reference; one to nothing stays itself."""
        return self.objects.get(tuple(value), value) if isinstance(value, Ref) else value

    def deep(self, value):
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                break
            value = self.resolve(value)
        return value

    def _decrypt(self, password: bytes) -> None:
        ref = self.trailer.get("Encrypt")
        d = self.deep(ref)
        if not isinstance(d, dict):
            return
        ids = self.deep(self.trailer.get("ID"))
        first = self.deep(ids[0]) if isinstance(ids, list) and ids else b""
        s = Security({k: self.deep(v) for k, v in d.items()}, first if isinstance(first, bytes) else b"", password)
        skip = tuple(ref) if isinstance(ref, Ref) else None

        def walk(v, n, g):
            if isinstance(v, bytes):
                return s.decrypt(v, n, g, s.string_way)
            if isinstance(v, list) and not isinstance(v, Ref):
                return [walk(x, n, g) for x in v]
            if isinstance(v, dict):
                return {k: walk(x, n, g) for k, x in v.items()}
            if isinstance(v, Stream):
                kind = v.dict.get("Type")
                if kind == "XRef" or (kind == "Metadata" and not s.metadata):
                    return v
                return Stream(walk(v.dict, n, g), s.decrypt(v.data, n, g, s.stream_way))
            return v

        for key in self.objects:
            if key != skip:
                self.objects[key] = walk(self.objects[key], *key)

    def _unpack(self) -> None:
        """Objects inside object streams, where no direct object has their number."""
        for key in sorted(k for k, v in self.objects.items() if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm"):
            stream = self.objects[key]
            body = self.decode(stream)
            n, first = self.deep(stream.dict.get("N")), self.deep(stream.dict.get("First"))
            if body is None or not isinstance(n, int) or not isinstance(first, int):
                continue
            lexer = Lexer(body)
            heads = []
            for _ in range(n):
                number, at = lexer.token(), lexer.token()
                if not isinstance(number, int) or not isinstance(at, int):
                    break
                heads.append((number, at))
            for number, at in heads:
                value = Lexer(body, first + at).value()
                if value is not END:
                    self.objects.setdefault((number, 0), value)

    def decode(self, stream) -> bytes | None:
        """A stream's data: plain, or deflated (what can be inflated of it); None for other filters."""
        stream = self.deep(stream)
        if not isinstance(stream, Stream):
            return None
        if id(stream) not in self._decoded:
            f = self.deep(stream.dict.get("Filter"))
            f = self.deep(f[0]) if isinstance(f, list) and f else f
            if f in (None, []):
                out = stream.data
            elif f == "FlateDecode":
                out = _inflated(stream.data)
            else:
                out = None
            self._decoded[id(stream)] = out
        return self._decoded[id(stream)]

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out: list[dict] = []
        seen: set = set()

        def walk(ref, above: dict, depth: int) -> None:
            node = self.deep(ref)
            if not isinstance(node, dict) or depth > PAGE_DEPTH or id(node) in seen:
                return
            seen.add(id(node))
            own = {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            down = above | own
            if node.get("Type") == "Page":
                out.append(down | node)
                return
            kids = self.deep(node.get("Kids"))
            for kid in kids if isinstance(kids, list) else []:
                walk(kid, down, depth + 1)

        root = self.deep(self.trailer.get("Root"))
        if isinstance(root, dict):
            walk(root.get("Pages"), {}, 0)
        return out

    def numbers(self, value, n: int) -> list[float] | None:
        value = self.deep(value)
        if not isinstance(value, list) or len(value) < n:
            return None
        got = [self.deep(x) for x in value[:n]]
        return [float(x) for x in got] if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in got) else None

    def box(self, value) -> tuple[float, float, float, float] | None:
        b = self.numbers(value, 4)
        return (min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])) if b else None

    def contents(self, page: dict) -> bytes:
        c = self.deep(page.get("Contents"))
        parts = [self.decode(x) for x in (c if isinstance(c, list) else [c])]
        return b"\n".join(p for p in parts if p is not None)

    def appearances(self, page: dict) -> list[tuple[Stream, list[float]]]:
        """The appearance stream of each annotation, with the matrix that maps its box to the annotation's place. Of several states, the first by name."""
        out = []
        annots = self.deep(page.get("Annots"))
        for a in annots if isinstance(annots, list) else []:
            a = self.deep(a)
            ap = self.deep(a.get("AP")) if isinstance(a, dict) else None
            stream = self._appearance(ap.get("N"), 0) if isinstance(ap, dict) else None
            if stream is None:
                continue
            own = self.numbers(stream.dict.get("Matrix"), 6) or [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
            r, b = self.box(a.get("Rect")), self.box(stream.dict.get("BBox"))
            move = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
            if r and b:
                sx = (r[2] - r[0]) / (b[2] - b[0]) if b[2] != b[0] else 1.0
                sy = (r[3] - r[1]) / (b[3] - b[1]) if b[3] != b[1] else 1.0
                move = [sx, 0.0, 0.0, sy, r[0] - b[0] * sx, r[1] - b[1] * sy]
            out.append((stream, compose(move, own)))
        return out

    def _appearance(self, value, depth: int) -> Stream | None:
        value = self.deep(value)
        if isinstance(value, Stream):
            return value
        if isinstance(value, dict) and depth < DEPTH:
            for k in sorted(value):
                if found := self._appearance(value[k], depth + 1):
                    return found
        return None


def compose(m: list[float], n: list[float]) -> list[float]:
    """The matrix that applies n, then m."""
    a, b, c, d, e, f = m
    g, h, i, j, k, q = n
    return [a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * q + e, b * k + d * q + f]


def _inflated(data: bytes) -> bytes:
    z = zlib.decompressobj()
    out = []
    try:
        for i in range(0, len(data), 4096):
            out.append(z.decompress(data[i : i + 4096]))
    except zlib.error:
        # the part of the last piece before the damage
        z = zlib.decompressobj()
        out = []
        for i in range(len(data)):
            try:
                out.append(z.decompress(data[i : i + 1]))
            except zlib.error:
                break
    return b"".join(out)


__all__ = ["Document", "Name", "Stream", "compose"]
