"""Patterns of a linear-time dialect (no look-around, no back-references) for Java's engine."""

from __future__ import annotations

import re

import regex

#: Marks around matches inside page bodies; removed from texts beforehand.
OPEN, CLOSE = "\ue000", "\ue001"

_FOREIGN = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k[<{']|\(\?P=")


class PatternError(ValueError):
    pass


def _tokens(pattern: str):
    """(text, inside a character class) for each character or escape."""
    i, depth = 0, 0
    while i < len(pattern):
        size = 2 if pattern[i] == "\\" and i + 1 < len(pattern) else 1
        yield pattern[i : i + size], depth > 0
        if size == 1:
            depth += (pattern[i] == "[") - (pattern[i] == "]" and depth > 0)
        i += size


#: POSIX classes, which are ASCII in this dialect (fixed values).
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_CLASS = re.compile(r"\[:(\^?)(\w+):\]")


def _checked(pattern: str) -> str:
    """The pattern with POSIX classes written out as nested ones, if it is of the dialect."""

    def posix(m: re.Match) -> str:
        if m[2] not in _POSIX:
            raise PatternError(f"unknown class {m[0]}")
        return f"[{m[1]}{_POSIX[m[2]]}]"

    plain = "".join(t for t, inside in _tokens(pattern) if not inside)
    if m := _FOREIGN.search(plain):
        raise PatternError(f"unsupported in patterns: {m[0]}")
    pattern = _CLASS.sub(posix, pattern) if "[:" in pattern else pattern
    inside = "".join(t if t_in else "\0" for t, t_in in _tokens(pattern))
    if m := re.search(r"--|~~", inside):
        raise PatternError(f"unsupported in classes: {m[0]}")
    try:
        regex.compile(_own(pattern), FLAGS)
    except regex.error as e:
        raise PatternError(f"invalid pattern: {e}") from None
    return pattern


FLAGS = regex.V1 | regex.IGNORECASE


def _own(pattern: str) -> str:
    """For Python's regex package: its end anchors also stand before a last line break."""
    end = r"\Z"
    return "".join(end if t == r"\z" or (t == "$" and not inside) else t for t, inside in _tokens(pattern))


def offsets(pattern: str) -> regex.Pattern:
    """The same pattern for Python's regex package, which tells where groups lie."""
    return regex.compile(_own(_checked(pattern)), FLAGS)


def java(pattern: str, ignore_case: bool = True) -> str:
    """The same pattern for Java: Unicode classes and case, and an end anchor that no line break softens."""
    out = "".join("\\z" if t == "$" and not inside else t for t, inside in _tokens(_checked(pattern)))
    return f"(?{'i' if ignore_case else ''}uUd)" + out.replace("(?P<", "(?<")
