"""Tokens and values of the PDF syntax."""

from __future__ import annotations

import re

# White space and delimiters of the syntax (fixed values).
SPACE, DELIMITER = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\n]*(?:\n|$))*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_PLAIN = re.compile(rb"[^()\\]*")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")


class Name(str):
    pass


class Word(bytes):
    """A keyword or operator."""


class Ref(tuple):
    """(object number, generation)."""


class Stream:
    def __init__(self, dict_: dict, data: bytes):
        self.dict, self.data = dict_, data


class _End:
    pass


END = _End()
_CLOSE = Word(b"]"), Word(b">>")


class Lexer:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def token(self):
        """The next token: a number, bytes for a string, a Name, or a Word, which brackets are too; END at the end."""
        data = self.data
        pos = _BLANK.match(data, self.pos).end()
        if pos >= len(data):
            self.pos = pos
            return END
        c = data[pos : pos + 1]
        if c == b"/":
            m = _REGULAR.match(data, pos + 1)
            self.pos = m.end()
            try:
                return Name(m[0].decode())
            except UnicodeDecodeError:
                return Name("")
        if c == b"(":
            return self._literal(pos + 1)
        if c == b"<" and data[pos + 1 : pos + 2] != b"<":
            end = data.find(b">", pos)
            end = len(data) if end < 0 else end
            digits = _NOT_HEX.sub(b"", data[pos + 1 : end])
            self.pos = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c in (b"<", b">") and data[pos + 1 : pos + 2] == c:
            self.pos = pos + 2
            return Word(c * 2)
        if c in b"[]{})>":
            self.pos = pos + 1
            return Word(c)
        m = _REGULAR.match(data, pos)
        self.pos = max(m.end(), pos + 1)
        return _number(m[0]) if c in b"+-.0123456789" else Word(m[0])

    def _literal(self, pos: int) -> bytes:
        data, out, depth = self.data, [], 1
        while pos < len(data):
            m = _PLAIN.match(data, pos)
            out.append(m[0])
            pos = m.end()
            c = data[pos : pos + 1]
            pos += 1
            if c == b"(":
                depth += 1
                out.append(c)
            elif c == b")":
                depth -= 1
                if not depth:
                    break
                out.append(c)
            elif c == b"\\":
                if m := _OCTAL.match(data, pos):
                    out.append(bytes([int(m[0], 8) & 0xFF]))
                    pos = m.end()
                elif data[pos : pos + 2] == b"\r\n":
                    pos += 2
                else:
                    e = data[pos : pos + 1]
                    out.append(b"" if e in (b"\n", b"\r") else _ESCAPES.get(e, e))
                    pos += 1
        self.pos = pos
        return b"".join(out)

    def value(self, token=None, refs: bool = True):
        """The next value, or the Word that stands in its place."""
        t = self.token() if token is None else token
        if not isinstance(t, Word):
            if refs and isinstance(t, int) and not isinstance(t, bool) and t >= 0:
                back = self.pos
                gen = self.token()
                if isinstance(gen, int) and gen >= 0 and self.token() == b"R":
                    return Ref((t, gen))
                self.pos = back
            return t
        if t == b"[":
            out = []
            while (x := self.value(refs=refs)) is not END and x != b"]":
                if not isinstance(x, Word):
                    out.append(x)
                elif x in (b"endobj", b">>"):
                    break
            return out
        if t == b"<<":
            out = {}
            while (k := self.token()) is not END and k != b">>":
                if not isinstance(k, Name):
                    if k == b"endobj":
                        break
                    continue
                v = self.value(refs=refs)
                if v is END:
                    break
                if isinstance(v, Word):
                    if v == b">>":
                        break
                    continue
                out[k] = v
            return out
        return {b"true": True, b"false": False, b"null": None}.get(bytes(t), t)


def _number(raw: bytes):
    try:
        return float(raw) if b"." in raw else int(raw)
    except ValueError:
        return 0
