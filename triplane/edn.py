"""A reader for the EDN notation that queries, rules, schemas and documents are written in.

Symbols and keywords become :class:`Symbol` and :class:`Keyword`, both strings; keywords keep their colon. Vectors become
lists, lists become tuples, sets become frozensets, maps become dicts. Queries may as well be given as Python data of
these types.
"""

from __future__ import annotations

import re
from datetime import datetime


class Symbol(str):
    """A symbol such as ``?e`` or ``sum``."""

    __slots__ = ()


class Keyword(str):
    """A keyword with its colon, such as ``:orders/custkey``."""

    __slots__ = ()


class Regex(str):
    """A regular expression literal."""

    __slots__ = ()


_TOKEN = re.compile(r"""[\s,]*(?:;[^\n]*[\s,]*)*(?:(#_)|(#\{)|(\#"(?:\\.|[^"\\])*")|("(?:\\.|[^"\\])*")|(\\(?:newline|space|tab|return|u[0-9a-fA-F]{4}|.))|([()\[\]{}])|(')|(\#[A-Za-z][^\s\[\](){}"]*)|([^\s,()\[\]{}";]+))?""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "b": "\b", "f": "\f"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_END = object()


def _string(raw: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)


def atom(token: str):
    """A number, boolean, nil, keyword or symbol."""
    if token in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[token]
    if re.fullmatch(r"[+-]?\d+N?", token):
        return int(token.rstrip("N"))
    if re.fullmatch(r"[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?M?", token):
        return float(token.rstrip("M"))
    if m := re.fullmatch(r"([+-]?\d+)/(\d+)", token):
        return int(m[1]) / int(m[2])
    return Keyword(token) if token[0] == ":" else Symbol(token)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next(self, close: str | None = None):
        m = _TOKEN.match(self.text, self.at)
        start, self.at = self.at, m.end()
        discard, set_, regex, string, char, bracket, quote, tag, other = m.groups()
        if discard:
            self.next()
            return self.next(close)
        if set_:
            return frozenset(map(_frozen, self.many("}")))
        if regex:
            return Regex(regex[2:-1])
        if string is not None:
            return _string(string[1:-1])
        if char:
            name = char[1:]
            return chr(int(name[1:], 16)) if len(name) == 5 and name[0] == "u" else _CHARS.get(name, name)
        if quote:
            return self.next(close)
        if tag:
            value = self.next()
            return datetime.fromisoformat(value.replace("Z", "+00:00")) if tag == "#inst" else value
        if bracket in _CLOSE:
            items = self.many(_CLOSE[bracket])
            if bracket == "{":
                if len(items) % 2:
                    raise ValueError("a map needs as many values as keys")
                return dict(zip(map(_frozen, items[::2]), items[1::2], strict=True))
            return tuple(items) if bracket == "(" else items
        if bracket:
            if bracket != close:
                raise ValueError(f"unexpected {bracket} at {start}")
            return _END
        if other:
            return atom(other)
        if close:
            raise ValueError(f"{close} is missing")
        return _END

    def many(self, close: str | None) -> list:
        out = []
        while (x := self.next(close)) is not _END:
            out.append(x)
        return out


def _frozen(x):
    if isinstance(x, list):
        return tuple(map(_frozen, x))
    return x


def read(text: str):
    """The first form of a text."""
    found = _Reader(text).next()
    if found is _END:
        raise ValueError("there is nothing to read")
    return found


def read_all(text: str) -> list:
    return _Reader(text).many(None)


def write(x) -> str:
    """EDN text of data."""
    if x is None:
        return "nil"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (Symbol, Keyword)):
        return str(x)
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(x, dict):
        return "{" + ", ".join(f"{write(k)} {write(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (set, frozenset)):
        return "#{" + " ".join(sorted(map(write, x))) + "}"
    if isinstance(x, tuple):
        return "(" + " ".join(map(write, x)) + ")"
    if isinstance(x, list):
        return "[" + " ".join(map(write, x)) + "]"
    if isinstance(x, datetime):
        return f'#inst "{x.isoformat()}"'
    return str(x)
