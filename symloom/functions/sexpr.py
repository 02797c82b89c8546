"""Reader of the query language: S-expressions to Python values.

Integers, reals, strings, symbols (:class:`Sym`), lists, ``#t``/``#f`` and regular expressions
(:class:`Regex`, written ``#/pattern/`` or ``#/pattern/i``); ``;`` starts a comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class DslError(ValueError):
    """The expression cannot be read or has no value of the wanted type."""


@dataclass(frozen=True)
class Sym:
    name: str


@dataclass(frozen=True)
class Regex:
    pattern: str
    icase: bool = False


_TOKEN = re.compile(
    r"""\s+|;[^\n]*|(?P<open>\()|(?P<close>\))|(?P<string>"(?:\\.|[^"\\])*")|(?P<regex>\#/(?:\\.|[^/\\])*/i?)"""
    r"""|(?P<bool>\#[tf](?![^\s()]))|(?P<quote>')|(?P<atom>[^\s()"';]+)""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "e": "\x1b"}


def read(text: str):
    """The one expression of ``text``; anything after it but blanks and comments is an error."""
    tokens = []
    pos = 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise DslError(f"cannot read at {pos}: {text[pos : pos + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        pos = m.end()
    value, rest = _read(tokens, 0)
    if rest != len(tokens):
        raise DslError(f"garbage after the expression: {tokens[rest][1]!r}")
    return value


def _read(tokens: list[tuple[str, str]], i: int):
    if i >= len(tokens):
        raise DslError("the expression ends too early")
    kind, t = tokens[i]
    if kind == "open":
        out = []
        i += 1
        while i < len(tokens) and tokens[i][0] != "close":
            v, i = _read(tokens, i)
            out.append(v)
        if i >= len(tokens):
            raise DslError("a list is not closed")
        return out, i + 1
    if kind == "close":
        raise DslError("a list is closed that was not opened")
    if kind == "quote":
        v, i = _read(tokens, i + 1)
        return [Sym("quote"), v], i
    if kind == "string":
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), t[1:-1], flags=re.S), i + 1
    if kind == "regex":
        icase = t.endswith("i")
        return Regex(t[2 : -2 if icase else -1].replace("\\/", "/"), icase), i + 1
    if kind == "bool":
        return t == "#t", i + 1
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t), i + 1
    if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?", t):
        return float(t), i + 1
    return Sym(t), i + 1


def write(v) -> str:
    """The text of a value, readable again."""
    if isinstance(v, bool):
        return "#t" if v else "#f"
    if isinstance(v, Sym):
        return v.name
    if isinstance(v, Regex):
        return f"#/{v.pattern.replace('/', chr(92) + '/')}/{'i' * v.icase}"
    if isinstance(v, str):
        body = v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
        return f'"{body}"'
    if isinstance(v, list):
        return "(" + " ".join(map(write, v)) + ")"
    return str(v)
