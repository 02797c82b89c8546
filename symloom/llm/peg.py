"""A small packrat parser: grammars are parsing-expression grammars in text.

    Rule <- A B / C        ordered choice of sequences
    A* A+ A? !A &A (A)     repetition, option, predicates, grouping
    'text'  ~/regex/       terminals

Names that the grammar does not define may be given as matchers ``f(text, position) -> end or None``: nested
brackets, which are counted in place of a recursion as deep as they nest (see :func:`balanced`).

Each rule's result at a position is kept, so no rule is tried twice at one place. A rule whose name
ends in ``@`` in its definition is captured: the parse yields (rule, start, end, children), offsets of the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Caps = tuple
Expr = Callable[[str, int, dict], "tuple[int, Caps] | None"]
_TOKEN = re.compile(r"\s*(?:(<-)|([A-Za-z_]\w*@?)|'((?:\\.|[^'\\])*)'|~/((?:\\.|[^/\\])*)/|([/*+?!&()]))")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    text = text.rstrip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"grammar: cannot read {text[pos : pos + 30]!r}")
        kind = ("arrow", "name", "text", "regex", "op")[m.lastindex - 1]
        out.append((kind, m.group(m.lastindex)))
        pos = m.end()
    return out


def balanced(opening: str, closing: str, skipped: str) -> Callable[[str, int], int | None]:
    """A matcher of one bracket with all that is nested in it; what ``skipped`` matches holds no brackets."""
    token = re.compile(f"{skipped}|[{re.escape(opening + closing)}]", re.S)

    def match(s: str, p: int) -> int | None:
        if not s.startswith(opening, p):
            return None
        depth = 0
        for m in token.finditer(s, p):
            if m.group() == opening:
                depth += 1
            elif m.group() == closing:
                depth -= 1
                if not depth:
                    return m.end()
        return None

    return match


class Grammar:
    def __init__(self, text: str, matchers: dict[str, Callable[[str, int], int | None]] | None = None) -> None:
        self.rules: dict[str, Expr] = {n: self._rule(n, self._matcher(f), False) for n, f in (matchers or {}).items()}
        self._t, self._i = _tokens(text), 0
        self.first = ""
        while self._i < len(self._t):
            name = self._t[self._i][1]
            self._i += 2
            keep = name.endswith("@")
            name = name.rstrip("@")
            self.first = self.first or name
            self.rules[name] = self._rule(name, self._choice(), keep)
        del self._t

    def parse(self, text: str, pos: int = 0) -> list[tuple]:
        """The captures of the first rule; the rule decides how far it reads."""
        got = self.rules[self.first](text, pos, {})
        return list(got[1]) if got else []

    @staticmethod
    def _matcher(f: Callable[[str, int], int | None]) -> Expr:
        return lambda s, p, memo: (e, ()) if (e := f(s, p)) is not None else None

    def _at(self, kind: str, value: str | None = None) -> bool:
        return self._i < len(self._t) and self._t[self._i][0] == kind and (value is None or self._t[self._i][1] == value)

    def _choice(self) -> Expr:
        options = [self._sequence()]
        while self._at("op", "/"):
            self._i += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]

        def choice(s, p, memo):
            for o in options:
                if (r := o(s, p, memo)) is not None:
                    return r
            return None

        return choice

    def _sequence(self) -> Expr:
        parts: list[Expr] = []
        while self._i < len(self._t) and not self._at("op", "/") and not self._at("op", ")"):
            if self._i + 1 < len(self._t) and self._t[self._i][0] == "name" and self._t[self._i + 1][0] == "arrow":
                break
            parts.append(self._prefixed())
        if len(parts) == 1:
            return parts[0]

        def sequence(s, p, memo):
            caps: Caps = ()
            for e in parts:
                if (r := e(s, p, memo)) is None:
                    return None
                p = r[0]
                if r[1]:
                    caps += r[1]
            return p, caps

        return sequence

    def _prefixed(self) -> Expr:
        if self._at("op", "!") or self._at("op", "&"):
            want = self._t[self._i][1] == "&"
            self._i += 1
            e = self._prefixed()
            return lambda s, p, memo: (p, ()) if (e(s, p, memo) is not None) == want else None
        e = self._primary()
        while self._i < len(self._t) and self._t[self._i] in (("op", "*"), ("op", "+"), ("op", "?")):
            e = self._repeat(e, self._t[self._i][1])
            self._i += 1
        return e

    @staticmethod
    def _repeat(e: Expr, how: str) -> Expr:
        if how == "?":
            return lambda s, p, memo: e(s, p, memo) or (p, ())

        def repeat(s, p, memo):
            caps: list = []
            n = 0
            while (r := e(s, p, memo)) is not None and r[0] > p:
                p = r[0]
                n += 1
                if r[1]:
                    caps.extend(r[1])
            return (p, tuple(caps)) if n or how == "*" else None

        return repeat

    def _primary(self) -> Expr:
        kind, value = self._t[self._i]
        self._i += 1
        if kind == "op":  # a group
            e = self._choice()
            self._i += 1
            return e
        if kind == "name":
            rules = self.rules
            return lambda s, p, memo: rules[value](s, p, memo)
        match = re.compile(re.escape(value) if kind == "text" else value.replace("\\/", "/"), re.S).match
        return lambda s, p, memo: (m.end(), ()) if (m := match(s, p)) else None

    @staticmethod
    def _rule(name: str, e: Expr, keep: bool) -> Expr:
        def rule(s, p, memo):
            key = (name, p)
            if key in memo:
                return memo[key]
            r = e(s, p, memo)
            if r is not None and keep:
                r = (r[0], ((name, p, r[0], r[1]),))
            memo[key] = r
            return r

        return rule
