"""The stack language of extraction patterns: a small postfix interpreter.

Objects: integers, booleans, mutable strings (:class:`Str`), names (:class:`Name`), arrays (lists),
procedures (:class:`Proc`), dictionaries, marks, null, match locations and entries. Errors raise
:class:`ScriptError` with the name of the error, which ``stopped`` catches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class ScriptError(Exception):
    def __init__(self, name: str, about: object = None) -> None:
        super().__init__(f"{name}: {about!r}")
        self.name = name


class Exit(Exception):
    """``exit`` leaves the innermost loop."""


class Stop(Exception):
    """``stop`` leaves to the innermost ``stopped``."""


class Quit(Exception):
    """``quit`` ends the script."""


@dataclass(frozen=True)
class Name:
    name: str
    literal: bool = False


class Proc(list):
    """An executable array."""


@dataclass
class Str:
    s: str

    def __eq__(self, other) -> bool:
        return isinstance(other, Str) and self.s == other.s

    def __hash__(self) -> int:
        return hash(self.s)


@dataclass(frozen=True)
class MatchLoc:
    offset: int
    line: int


class Mark:
    pass


MARK = Mark()
_TOKEN = re.compile(r"\s+|%[^\n]*|(\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\))|(<<|>>|[\[\]{}])|([^\s()\[\]{}%]+)", re.S)
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "b": "\b"}


def compile_script(text: str) -> Proc:
    """The script as a procedure."""
    stack: list[Proc] = [Proc()]
    pos = 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ScriptError("syntaxerror", text[pos : pos + 20])
        pos = m.end()
        string, bracket, word = m.groups()
        if string is not None:
            stack[-1].append(("str", re.sub(r"\\(.)", lambda x: _UNESCAPE.get(x.group(1), x.group(1)), string[1:-1], flags=re.S)))
        elif bracket == "{":
            stack.append(Proc())
        elif bracket == "}":
            if len(stack) == 1:
                raise ScriptError("syntaxerror", "}")
            done = stack.pop()
            stack[-1].append(done)
        elif bracket:
            stack[-1].append(Name(bracket))
        elif word:
            if re.fullmatch(r"[+-]?\d+", word):
                stack[-1].append(int(word))
            elif m16 := re.fullmatch(r"(\d+)#([0-9A-Za-z]+)", word):
                stack[-1].append(int(m16.group(2), int(m16.group(1))))
            elif word.startswith("/") and len(word) > 1:
                stack[-1].append(Name(word[1:], literal=True))
            else:
                stack[-1].append(Name(word))
    if len(stack) != 1:
        raise ScriptError("syntaxerror", "{ is not closed")
    return stack[0]


@dataclass
class Context:
    """What a pattern's match offers to its script; entries are dictionaries of an extractor."""

    groups: tuple = ()
    spans: tuple = ()
    entries: list = field(default_factory=list)
    current: int | None = None
    host: object = None  # the extractor: scopes, tables, promises
    params: dict = field(default_factory=dict)
    line_of: Callable[[int], int] = lambda offset: 0


class Machine:
    def __init__(self, context: Context | None = None, limit: int = 1_000_000) -> None:
        self.ctx = context or Context()
        self.stack: list = []
        self.dicts: list[dict] = [{}]
        self.out: list[str] = []
        self.error: str | None = None
        self.steps, self.limit = 0, limit
        self.running: list[Proc] = []

    def run(self, proc: Proc) -> list:
        try:
            self.execute(proc)
        except Quit:
            pass
        return self.stack

    def execute(self, proc: Proc) -> None:
        self.running.append(proc)
        try:
            self._each(proc)
        finally:
            self.running.pop()

    def _each(self, proc: Proc) -> None:
        for x in proc:
            self.steps += 1
            if self.steps > self.limit:
                raise ScriptError("timeout")
            if isinstance(x, tuple):
                self.stack.append(Str(x[1]))
            elif isinstance(x, Name) and not x.literal:
                self.call(x.name)
            else:
                self.stack.append(x)

    def call(self, name: str) -> None:
        for d in reversed(self.dicts):
            if name in d:
                v = d[name]
                self.execute(v) if isinstance(v, Proc) else self.stack.append(v)
                return
        op = OPS.get(name)
        if op is not None:
            op(self)
        elif name[:1] == "\\" and name[1:].isdigit():
            g = int(name[1:])
            v = self.ctx.groups[g] if g < len(self.ctx.groups) else None
            self.stack.append(False if v is None else Str(v))
        elif name == ".":
            if self.ctx.current is None:
                raise ScriptError("undefined", ".")
            self.stack.append(self.ctx.current)
        elif name[:1] == ":" and len(name) > 1:
            self.stack.append(self.get_field(self.entry(self.pop()), name[1:]))
        elif name[-1:] == ":" and len(name) > 1:
            v = self.pop()
            self.set_field(self.entry(self.pop()), name[:-1], v)
        else:
            raise ScriptError("undefined", name)

    def pop(self, *types):
        if not self.stack:
            raise ScriptError("stackunderflow")
        v = self.stack.pop()
        if types and (not isinstance(v, types) or (isinstance(v, bool) and bool not in types)):
            self.stack.append(v)
            raise ScriptError("typecheck", v)
        return v

    def entry(self, ref) -> dict:
        if isinstance(ref, dict) and "name" in ref:
            return ref
        if isinstance(ref, int) and 0 < ref <= len(self.ctx.entries):
            return self.ctx.entries[ref - 1]
        raise ScriptError("typecheck", ref)

    def get_field(self, e: dict, name: str):
        if name == "scope":
            return e.get("scope_id") or 0
        if name == "roles" or name == "extras":
            return [Name(x, True) for x in e.get(name) or []]
        v = e.get(name, (e.get("fields") or {}).get(name))
        if name in ("kind", "language") and v is not None:
            return Name(v, True)
        if name == "typeref" and v is not None:
            return [Str(x) for x in v.split(":", 1)]
        return None if v is None else Str(v) if isinstance(v, str) else v

    def set_field(self, e: dict, name: str, v) -> None:
        if isinstance(v, MatchLoc):
            v = v.line
        if name == "typeref" and isinstance(v, list):
            e["typeref"] = ":".join(text_of(x) for x in v)
            return
        v = v.s if isinstance(v, Str) else v.name if isinstance(v, Name) else v
        if name == "scope":
            e["scope_id"] = v or None
        elif name == "typeref":
            e["typeref"] = v if isinstance(v, str) and ":" in v else f"typename:{v}"
        elif name in ("name", "line", "end", "access", "signature", "inherits", "kind", "pattern", "nth", "xpath", "language", "input"):
            e[name] = v
        else:
            e.setdefault("fields", {})[name] = str(v).lower() if isinstance(v, bool) else str(v)

    def index_of(self, i: int) -> int:
        if i < 0 or i >= len(self.stack):
            raise ScriptError("rangecheck", i)
        return len(self.stack) - 1 - i

    def mark_at(self) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] is MARK:
                return i
        raise ScriptError("unmatchedmark")


OPS: dict[str, Callable[[Machine], None]] = {}


def op(*names: str):
    def put(f):
        for n in names:
            OPS[n] = f
        return f

    return put


def text_of(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if v is None:
        return "null"
    if isinstance(v, Str):
        return v.s
    if isinstance(v, Name):
        return v.name
    if isinstance(v, Proc):
        return "{" + " ".join(map(repr_of, v)) + "}"
    if isinstance(v, list):
        return "[" + " ".join(map(repr_of, v)) + "]"
    if isinstance(v, dict):
        return f"-dict:{len(v)}-"
    return "-mark-" if v is MARK else str(v)


def repr_of(v) -> str:
    if isinstance(v, Str):
        return f"({v.s})"
    if isinstance(v, tuple):
        return f"({v[1]})"
    if isinstance(v, Name) and v.literal:
        return "/" + v.name
    return text_of(v)


def _key(v):
    return v.name if isinstance(v, Name) else v.s if isinstance(v, Str) else v


def _scalar(name: str, f: Callable, *types: type):
    def run(m: Machine) -> None:
        b = m.pop(*types)
        m.stack.append(f(m.pop(*types), b))

    OPS[name] = run


def _divide(a: int, b: int) -> int:
    if b == 0:
        raise ScriptError("undefinedresult")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


_scalar("add", lambda a, b: a + b, int)
_scalar("sub", lambda a, b: a - b, int)
_scalar("mul", lambda a, b: a * b, int)
_scalar("idiv", _divide, int)
_scalar("mod", lambda a, b: a - b * _divide(a, b), int)
_scalar("bitshift", lambda a, b: a << b if b >= 0 else a >> -b, int)
OPS["abs"] = lambda m: m.stack.append(abs(m.pop(int)))
OPS["neg"] = lambda m: m.stack.append(-m.pop(int))
OPS["eq"] = lambda m: m.stack.append((lambda b, a: type(a) is type(b) and a == b if not isinstance(a, (Name, Str)) else _key(a) == _key(b))(m.pop(), m.pop()))
OPS["ne"] = lambda m: (OPS["eq"](m), m.stack.append(not m.stack.pop()))[0]


def _ordered(name: str, f: Callable):
    def run(m: Machine) -> None:
        b, a = m.pop(int, Str), m.pop(int, Str)
        if type(a) is not type(b):
            raise ScriptError("typecheck", b)
        m.stack.append(f(_key(a), _key(b)))

    OPS[name] = run


_ordered("ge", lambda a, b: a >= b)
_ordered("gt", lambda a, b: a > b)
_ordered("le", lambda a, b: a <= b)
_ordered("lt", lambda a, b: a < b)


def _logic(name: str, f: Callable):
    def run(m: Machine) -> None:
        b, a = m.pop(int, bool), m.pop(int, bool)
        if type(a) is not type(b):
            raise ScriptError("typecheck", b)
        m.stack.append(f(a, b))

    OPS[name] = run


_logic("and", lambda a, b: a & b)
_logic("or", lambda a, b: a | b)
_logic("xor", lambda a, b: a ^ b)
OPS["not"] = lambda m: (lambda a: m.stack.append(not a if isinstance(a, bool) else ~a))(m.pop(int, bool))
OPS["true"] = lambda m: m.stack.append(True)
OPS["false"] = lambda m: m.stack.append(False)
OPS["null"] = lambda m: m.stack.append(None)
OPS["pop"] = lambda m: m.pop() and None
OPS["dup"] = lambda m: m.stack.append(m.stack[m.index_of(0)]) if m.stack else m.pop()
OPS["clear"] = lambda m: m.stack.clear()
OPS["count"] = lambda m: m.stack.append(len(m.stack))
OPS["mark"] = OPS["["] = OPS["<<"] = lambda m: m.stack.append(MARK)


@op("exch")
def _exch(m: Machine) -> None:
    b, a = m.pop(), m.pop()
    m.stack += [b, a]


@op("index")
def _index(m: Machine) -> None:
    n = m.pop(int)
    m.stack.append(m.stack[m.index_of(n)])


@op("roll")
def _roll(m: Machine) -> None:
    j, n = m.pop(int), m.pop(int)
    if n < 0 or n > len(m.stack):
        raise ScriptError("rangecheck", n)
    if n:
        top = m.stack[-n:]
        j %= n
        m.stack[-n:] = top[-j:] + top[:-j] if j else top


@op("cleartomark")
def _cleartomark(m: Machine) -> None:
    del m.stack[m.mark_at() :]


OPS["counttomark"] = lambda m: m.stack.append(len(m.stack) - 1 - m.mark_at())


@op("]")
def _array_end(m: Machine) -> None:
    i = m.mark_at()
    items = m.stack[i + 1 :]
    del m.stack[i:]
    m.stack.append(items)


@op(">>")
def _dict_end(m: Machine) -> None:
    _array_end(m)
    items = m.stack.pop()
    if len(items) % 2:
        raise ScriptError("rangecheck")
    m.stack.append({_key(k): v for k, v in zip(items[::2], items[1::2], strict=True)})


OPS["array"] = lambda m: m.stack.append([None] * m.pop(int))
OPS["dict"] = lambda m: (m.pop(int), m.stack.append({}))[1]
OPS["string"] = lambda m: m.stack.append(Str("\0" * m.pop(int)))


@op("astore")
def _astore(m: Machine) -> None:
    a = m.pop(list)
    n = len(a)
    if n > len(m.stack):
        raise ScriptError("stackunderflow")
    if n:
        a[:] = m.stack[-n:]
        del m.stack[-n:]
    m.stack.append(a)


@op("aload")
def _aload(m: Machine) -> None:
    a = m.pop(list)
    m.stack += [*a, a]


OPS["begin"] = lambda m: m.dicts.append(m.pop(dict))


@op("end")
def _end(m: Machine) -> None:
    if len(m.dicts) == 1:
        raise ScriptError("dictstackunderflow")
    m.dicts.pop()


@op("def")
def _def(m: Machine) -> None:
    v = m.pop()
    m.dicts[-1][_key(m.pop(Name, Str, int))] = v


@op("load")
def _load(m: Machine) -> None:
    k = _key(m.pop())
    for d in reversed(m.dicts):
        if k in d:
            m.stack.append(d[k])
            return
    raise ScriptError("undefined", k)


@op("undef")
def _undef(m: Machine) -> None:
    k = _key(m.pop())
    m.pop(dict).pop(k, None)


OPS["known"] = lambda m: (lambda k: m.stack.append(k in m.pop(dict)))(_key(m.pop()))


@op("where")
def _where(m: Machine) -> None:
    k = _key(m.pop())
    for d in reversed(m.dicts):
        if k in d:
            m.stack += [d, True]
            return
    m.stack.append(False)


@op("store")
def _store(m: Machine) -> None:
    v = m.pop()
    k = _key(m.pop())
    for d in reversed(m.dicts):
        if k in d:
            d[k] = v
            return
    m.dicts[-1][k] = v


OPS["currentdict"] = lambda m: m.stack.append(m.dicts[-1])
OPS["countdictstack"] = lambda m: m.stack.append(len(m.dicts))
OPS["dictstack"] = lambda m: (lambda a: m.stack.append(a.__setitem__(slice(None), list(m.dicts)) or a))(m.pop(list))


@op("cleardictstack")
def _cleardictstack(m: Machine) -> None:
    del m.dicts[1:]


def _find(name: str, f: Callable[[str, str], int]):
    def run(m: Machine) -> None:
        k = m.pop(Str, int)
        s = m.pop(Str)
        at = f(s.s, chr(k) if isinstance(k, int) else k.s)
        m.stack += [s, at, True] if at >= 0 else [s, False]

    OPS[name] = run


_find("_strstr", lambda s, k: s.find(k))
_find("_strrstr", lambda s, k: s.rfind(k))
_find("_strchr", lambda s, k: s.find(k))
_find("_strrchr", lambda s, k: s.rfind(k))
_find("_strpbrk", lambda s, k: min((i for c in k if (i := s.find(c)) >= 0), default=-1))


def _execute_any(m: Machine, v) -> None:
    if isinstance(v, Proc):
        m.execute(v)
    elif isinstance(v, Name) and not v.literal:
        m.call(v.name)
    else:
        m.stack.append(v)


OPS["exec"] = lambda m: _execute_any(m, m.pop())


@op("if")
def _if(m: Machine) -> None:
    p = m.pop(Proc)
    if m.pop(bool):
        m.execute(p)


@op("ifelse")
def _ifelse(m: Machine) -> None:
    f, t = m.pop(Proc), m.pop(Proc)
    m.execute(t if m.pop(bool) else f)


@op("repeat")
def _repeat(m: Machine) -> None:
    p, n = m.pop(Proc), m.pop(int)
    try:
        for _ in range(n):
            m.execute(p)
    except Exit:
        pass


@op("loop")
def _loop(m: Machine) -> None:
    p = m.pop(Proc)
    try:
        while True:
            m.steps += 1
            m.execute(p)
            if m.steps > m.limit:
                raise ScriptError("timeout")
    except Exit:
        pass


@op("for")
def _for(m: Machine) -> None:
    p, limit, step, i = m.pop(Proc), m.pop(int), m.pop(int), m.pop(int)
    if step == 0:
        raise ScriptError("rangecheck", step)
    try:
        while i <= limit if step > 0 else i >= limit:
            m.stack.append(i)
            m.execute(p)
            i += step
    except Exit:
        pass


@op("forall")
def _forall(m: Machine) -> None:
    p = m.pop(Proc)
    v = m.pop(list, dict, Str)
    try:
        if isinstance(v, dict):
            for k, x in list(v.items()):
                m.stack += [Name(k, True) if isinstance(k, str) else k, x]
                m.execute(p)
        else:
            for x in [ord(c) for c in v.s] if isinstance(v, Str) else list(v):
                m.stack.append(x)
                m.execute(p)
    except Exit:
        pass


def _raiser(e: type[Exception]):
    def run(m: Machine) -> None:
        raise e()

    return run


OPS["exit"], OPS["stop"], OPS["quit"] = _raiser(Exit), _raiser(Stop), _raiser(Quit)


@op("stopped")
def _stopped(m: Machine) -> None:
    v = m.pop()
    try:
        _execute_any(m, v)
        m.stack.append(False)
    except Stop:
        m.stack.append(True)
    except ScriptError as e:
        m.error = e.name
        m.stack.append(True)


OPS["_newerror"] = lambda m: m.stack.append(m.error is not None)
OPS["_errorname"] = lambda m: m.stack.append(Name(m.error, True) if m.error else None)
OPS["countexecstack"] = lambda m: m.stack.append(len(m.running))


@op("execstack")
def _execstack(m: Machine) -> None:
    """The procedures that run, the outermost first, put into the array."""
    a = m.pop(list)
    if len(a) < len(m.running):
        raise ScriptError("rangecheck", len(a))
    a[: len(m.running)] = m.running
    m.stack.append(a[: len(m.running)])




@op("type")
def _type(m: Machine) -> None:
    v = m.pop()
    kinds = ((bool, "booleantype"), (int, "integertype"), (Str, "stringtype"), (Name, "nametype"), (list, "arraytype"), (dict, "dicttype"), (Mark, "marktype"), (MatchLoc, "matchloctype"))
    m.stack.append(Name(next((n for t, n in kinds if isinstance(v, t)), "nulltype"), True))


OPS["cvn"] = lambda m: m.stack.append(Name(m.pop(Str).s, True))
OPS["cvx"] = lambda m: (lambda v: m.stack.append(Name(v.name) if isinstance(v, Name) else Proc(v) if isinstance(v, list) else compile_script(v.s) if isinstance(v, Str) else v))(m.pop())
OPS["bind"] = lambda m: None


@op("cvs")
def _cvs(m: Machine) -> None:
    s = m.pop(Str)
    s.s = text_of(m.pop())
    m.stack.append(s)


@op("copy")
def _copy(m: Machine) -> None:
    v = m.pop()
    if isinstance(v, int) and not isinstance(v, bool):
        if v < 0 or v > len(m.stack):
            raise ScriptError("rangecheck", v)
        m.stack += m.stack[len(m.stack) - v :]
        return
    src = m.pop(type(v))
    if isinstance(v, Str):
        v.s = src.s + v.s[len(src.s) :]
    elif isinstance(v, dict):
        v.update(src)
    else:
        v[: len(src)] = src
    m.stack.append(v)


OPS["length"] = lambda m: (lambda v: m.stack.append(len(_key(v)) if isinstance(v, (Str, Name)) else len(v)))(m.pop(list, dict, Str, Name))


@op("get")
def _get(m: Machine) -> None:
    k = m.pop()
    v = m.pop(list, dict, Str)
    try:
        m.stack.append(ord(v.s[k]) if isinstance(v, Str) else v[_key(k)] if isinstance(v, dict) else v[k])
    except (KeyError, IndexError) as e:
        raise ScriptError("undefined" if isinstance(v, dict) else "rangecheck", k) from e


@op("put")
def _put(m: Machine) -> None:
    x, k = m.pop(), m.pop()
    v = m.pop(list, dict, Str)
    if isinstance(v, Str):
        if k > len(v.s):
            raise ScriptError("rangecheck", k)
        v.s = v.s[:k] + chr(x) + v.s[k + 1 :]
    elif isinstance(v, dict):
        v[_key(k)] = x
    else:
        if k >= len(v):
            raise ScriptError("rangecheck", k)
        v[k] = x


@op("putinterval")
def _putinterval(m: Machine) -> None:
    src = m.pop(list, Str)
    i = m.pop(int)
    dst = m.pop(list, Str)
    if isinstance(dst, Str):
        dst.s = dst.s[:i] + src.s + dst.s[i + len(src.s) :]
    else:
        dst[i : i + len(src)] = src


@op("_copyinterval")
def _copyinterval(m: Machine) -> None:
    dst = m.pop(list, Str)
    n, i = m.pop(int), m.pop(int)
    src = m.pop(list, Str)
    if isinstance(dst, Str):
        dst.s += src.s[i : i + n]
    else:
        dst += src[i : i + n]
    m.stack.append(dst)


for _n, _f, _nl in (("=", text_of, "\n"), ("==", repr_of, "\n"), ("===", repr_of, "\n"), ("====", repr_of, "\n"), ("=+", text_of, ""), ("==+", repr_of, "")):
    OPS[_n] = lambda m, f=_f, nl=_nl: m.out.append(f(m.pop()) + nl)
OPS["pstack"] = lambda m: m.out.extend(repr_of(x) + "\n" for x in reversed(m.stack))
OPS["_help"] = lambda m: m.out.append("\n".join(sorted(OPS)) + "\n")


# --- matches and entries ------------------------------------------------------------------------


@op("_matchstr")
def _matchstr(m: Machine) -> None:
    g = m.pop(int)
    v = m.ctx.groups[g] if g < len(m.ctx.groups) else None
    m.stack += [Str(v), True] if v is not None else [False]


@op("_matchloc")
def _matchloc(m: Machine) -> None:
    side = m.pop()
    if isinstance(side, Name):
        g = m.pop(int)
    else:
        g, side = side, Name("start", True)
    if g >= len(m.ctx.spans) or m.ctx.spans[g][0] < 0:
        raise ScriptError("rangecheck", g)
    at = m.ctx.spans[g][1 if side.name == "end" else 0]
    m.stack.append(MatchLoc(at, m.ctx.line_of(at)))


OPS["_matchloc2line"] = lambda m: m.stack.append(m.pop(MatchLoc).line)
OPS["_tagloc"] = lambda m: (lambda e: m.stack.append(MatchLoc(e.get("offset", 0), e["line"])))(m.entry(m.pop()))


def _new_tag(m: Machine, name, lang, kind, role, loc: MatchLoc) -> dict:
    e = {"name": _key(name), "kind": _key(kind), "line": loc.line, "roles": [_key(role)] if role is not None else [], "extras": [], "fields": {}}
    if lang is not None:
        e["language"] = _key(lang)
    return e


@op("_foreignreftag")
def _foreignreftag(m: Machine) -> None:
    loc, role, kind, lang, name = m.pop(MatchLoc), m.pop(), m.pop(Name), m.pop(), m.pop(Str)
    m.stack.append(_new_tag(m, name, lang, kind, role, loc))


@op("_foreigntag")
def _foreigntag(m: Machine) -> None:
    loc, kind, lang, name = m.pop(MatchLoc), m.pop(Name), m.pop(), m.pop(Str)
    m.stack.append(_new_tag(m, name, lang, kind, None, loc))


@op("_reftag")
def _reftag(m: Machine) -> None:
    loc, role, kind, name = m.pop(MatchLoc), m.pop(), m.pop(Name), m.pop(Str)
    m.stack.append(_new_tag(m, name, None, kind, role, loc))


@op("_tag")
def _tag(m: Machine) -> None:
    loc, kind, name = m.pop(MatchLoc), m.pop(Name), m.pop(Str)
    m.stack.append(_new_tag(m, name, None, kind, None, loc))


@op("_commit")
def _commit(m: Machine) -> None:
    e = m.pop(dict)
    m.ctx.entries.append(e)
    m.stack.append(len(m.ctx.entries))


OPS["_scopetop"] = lambda m: m.stack.extend([m.ctx.host.scopes[-1], True] if m.ctx.host.scopes else [False])
OPS["_scopepush"] = lambda m: m.ctx.host.scopes.append(m.pop(int))
OPS["_scopepop"] = lambda m: m.ctx.host.scopes and m.ctx.host.scopes.pop() and None
OPS["_scopeclear"] = lambda m: m.ctx.host.scopes.clear()
OPS["_scopeset"] = lambda m: m.ctx.host.scopes.__setitem__(slice(None), [m.pop(int)])
OPS["_scopedepth"] = lambda m: m.stack.append(len(m.ctx.host.scopes))
OPS["_scopeNth"] = lambda m: (lambda n: m.stack.append(m.ctx.host.scopes[-1 - n]))(m.pop(int))


@op("_scoperef")
def _scoperef(m: Machine) -> None:
    e = m.entry(m.pop())
    if m.ctx.host.scopes:
        e["scope_id"] = m.ctx.host.scopes[-1]


def _table(name: str, how: str, args: int):
    def run(m: Machine) -> None:
        got = [_key(m.pop(Name)) for _ in range(args)][::-1]
        m.ctx.host.table_action = (how, *got)

    OPS[name] = run


for _n, _h, _a in (("_tenter", "tenter", 1), ("_tentercont", "tenter", 2), ("_tleave", "tleave", 0), ("_tjump", "tjump", 1), ("_treset", "treset", 1), ("_tquit", "tquit", 0)):
    _table(_n, _h, _a)
OPS["_extraenabled"] = lambda m: m.stack.append(_key(m.pop(Name)) in getattr(m.ctx.host, "extras", ()))


@op("_markextra")
def _markextra(m: Machine) -> None:
    x = _key(m.pop(Name))
    e = m.entry(m.pop())
    e["extras"] = [*dict.fromkeys([*(e.get("extras") or []), x])]


@op("_assignrole")
def _assignrole(m: Machine) -> None:
    r = _key(m.pop(Name))
    e = m.entry(m.pop())
    e["roles"] = [*dict.fromkeys([*(e.get("roles") or []), r])]


@op("_unassignrole")
def _unassignrole(m: Machine) -> None:
    r = _key(m.pop(Name))
    e = m.entry(m.pop())
    e["roles"] = [x for x in e.get("roles") or [] if x != r]


OPS["_markplaceholder"] = lambda m: m.entry(m.pop()).__setitem__("placeholder", True)
OPS["_advanceto"] = lambda m: setattr(m.ctx.host, "advance_to", m.pop(MatchLoc).offset)
OPS["_traced"] = lambda m: m.stack.append(False)
OPS["_repl"] = lambda m: None


@op("_param")
def _param(m: Machine) -> None:
    k = _key(m.pop(Name))
    m.stack += [Str(m.ctx.params[k]), True] if k in m.ctx.params else [False]


@op("_makepromise")
def _makepromise(m: Machine) -> None:
    end, start, lang = m.pop(MatchLoc), m.pop(MatchLoc), m.pop(Str)
    if end.offset <= start.offset:
        m.stack.append(False)
        return
    m.ctx.host.promises.append((lang.s, start.offset, end.offset))
    m.stack += [len(m.ctx.host.promises), True]


@op("_intervaltab")
def _intervaltab(m: Machine) -> None:
    v = m.pop()
    if isinstance(v, MatchLoc):
        lo = hi = v.line
    elif isinstance(v, list):
        lo, hi = v[0], v[-1]
    else:
        e = m.entry(v)
        lo = hi = e["line"]
    held = [(e["line"], i + 1) for i, e in enumerate(m.ctx.entries) if (e.get("end") or 0) > e["line"] and e["line"] <= hi and e["end"] >= lo]
    m.stack += [max(held)[1], True] if held else [False]


@op("_anongen")
def _anongen(m: Machine) -> None:
    kind = m.pop(Name)
    prefix = m.pop()
    if isinstance(prefix, Name):  # a language stands between
        prefix = m.pop(Str)
    m.stack.append(Str(m.ctx.host.anonymous(prefix.s, kind.name)))


# --- small procedures of the prelude -------------------------------------------------------------


@op("_ndup")
def _ndup(m: Machine) -> None:
    n = m.pop(int)
    v = m.pop()
    m.stack += [v] * n


@op("_dedup", "_dedup_spaces")
def _dedup(m: Machine) -> None:
    b, a = m.pop(), m.pop()
    m.stack += [a] if a == b else [a, b]


@op("_buildstring")
def _buildstring(m: Machine) -> None:
    _array_end(m)
    m.stack.append(Str("".join(chr(x) if isinstance(x, int) else text_of(x) for x in m.stack.pop())))


@op("_putlast!")
def _putlast(m: Machine) -> None:
    v = m.pop(int, Str)
    m.pop(Str).s += chr(v) if isinstance(v, int) else v.s


@op("_tr!")
def _tr(m: Machine) -> None:
    pair, s = m.pop(Str), m.pop(Str)
    if len(pair.s) != 2:
        raise ScriptError("rangecheck", pair.s)
    s.s = s.s.replace(pair.s[0], pair.s[1])


@op("_normalize_spaces!")
def _normalize(m: Machine) -> None:
    s = m.pop(Str)
    s.s = re.sub(r"\s+", " ", s.s)


@op("_chop")
def _chop(m: Machine) -> None:
    m.stack.append(Str(m.pop(Str).s[:-1]))


@op("_chop_space")
def _chop_space(m: Machine) -> None:
    m.stack.append(Str(m.pop(Str).s.rstrip()))


@op("_isstring")
def _isstring(m: Machine) -> None:
    m.stack.append(isinstance(m.stack[m.index_of(0)], Str))


@op("_amember")
def _amember(m: Machine) -> None:
    k, a = m.pop(), m.pop(list)
    m.stack.append(any(_key(x) == _key(k) for x in a))


@op("_aindex")
def _aindex(m: Machine) -> None:
    k, a = m.pop(), m.pop(list)
    at = next((i for i, x in enumerate(a) if _key(x) == _key(k)), -1)
    m.stack += [at, True] if at >= 0 else [False]
