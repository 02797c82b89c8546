"""The query language compiled to Catalyst columns: filter (``-Q``), formatter (``-F``) and sorter (``-S``).

A missing value (``#f``) is NULL of its column; only ``#f`` is false, so 0 and "" are true. Types are
static: comparing values of different types is false, and operators on wrong types are compile errors.
A NULL where a value is needed is an error of that row: ``strict`` raises it inside the same ``CASE``
as its guard, otherwise the row counts as ``#f``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.regex import to_java
from symloom.functions.sexpr import DslError, Regex, Sym, read, write

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The variables of an entry and their types.
VARIABLES = {
    "name": "str", "input": "str", "pattern": "str", "line": "int", "access": "str", "end": "int", "extras": "str", "file": "bool", "inherits": "str",
    "implementation": "str", "nth": "int", "kind": "str", "language": "str", "scope": "str", "scope-kind": "str", "scope-name": "str", "signature": "str",
    "typeref": "str", "typeref-kind": "str", "typeref-name": "str", "roles": "str", "xpath": "str",
}


@dataclass(frozen=True)
class Val:
    """A typed value: type is bool, int, real, str, list, regex, false or nil; ``col`` its column."""

    type: str
    col: Column | None = None
    items: tuple[Val, ...] = ()
    literal: object = None
    total: bool = False  # never NULL
    raw: Column | None = None  # the bare column of a value that counts 0 as missing

    def truthy(self) -> Column:
        if self.type == "bool":
            return self.col if self.total else F.coalesce(self.col, F.lit(False))
        if self.type == "false":
            return F.lit(False)
        if self.total or self.type in ("nil", "regex") or self.type == "list" and self.col is None:
            return F.lit(True)
        return self.col.isNotNull()


class Row:
    """Where variables get their columns: a mapping of column names, and a map column for other fields."""

    def __init__(self, columns: Mapping[str, Column | str], fields: Column | str | None = None) -> None:
        self.columns = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        self.fields = F.col(fields) if isinstance(fields, str) else fields

    def variable(self, name: str) -> Val:
        """``$name``; scope and typeref split at their first colon unless their parts are given."""
        kind = VARIABLES[name]
        c = self.columns.get(name)
        if c is None and name in ("scope-kind", "scope-name", "typeref-kind", "typeref-name"):
            whole = self.columns.get(name.split("-")[0])
            if whole is None:
                whole = self._field(name.split("-")[0])
            if name.endswith("kind"):
                c = F.when(whole.contains(":"), F.substring_index(whole, ":", 1))
            else:
                c = F.nullif(F.when(whole.contains(":"), F.substr(whole, F.instr(whole, ":") + F.lit(1))), F.lit(""))
        if c is None:
            c = self._field(name)
            if kind == "int":
                c = c.try_cast("int")
        if kind == "bool":
            return Val("bool", F.coalesce(c.cast("boolean"), F.lit(False)), total=True)
        if kind == "int":
            c = c.cast("long")
            return Val("int", F.nullif(c, F.lit(0)), raw=c) if name == "line" else Val("int", c)
        return Val("str", c.cast("string"))

    def _field(self, key: str) -> Column:
        if self.fields is None:
            return F.lit(None).cast("string")
        return F.try_element_at(self.fields, F.lit(key))

    def dollar(self, key: str) -> Val:
        if key in VARIABLES:
            return self.variable(key)
        return Val("str", self._field(key))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


class Compiler:
    def __init__(self, row: Row, other: Row | None = None, strict: bool = False) -> None:
        self.row, self.other, self.strict = row, other, strict

    def value(self, e) -> Val:
        if isinstance(e, bool):
            return Val("bool", F.lit(True), literal=True, total=True) if e else Val("false")
        if isinstance(e, int):
            return Val("int", F.lit(e).cast("long"), literal=e, total=True)
        if isinstance(e, float):
            return Val("real", F.lit(e), literal=e, total=True)
        if isinstance(e, str):
            return Val("str", F.lit(e), literal=e, total=True)
        if isinstance(e, Regex):
            return Val("regex", literal=e, total=True)
        if isinstance(e, Sym):
            return self.symbol(e.name)
        if not e:
            return Val("nil", literal=[], total=True)
        head, args = e[0], e[1:]
        if isinstance(head, Sym):
            if head.name == "quote":
                return self._quoted(args[0])
            op = OPERATORS.get(head.name)
            if op is None:
                raise DslError(f"unbound operator: {head.name}")
            return op(self, args)
        callee = self.value(head)
        if callee.type != "regex":
            raise DslError(f"not callable: {write(head)}")
        return self.match(callee, args)

    def _quoted(self, e) -> Val:
        if isinstance(e, list):
            items = tuple(self._quoted(x) for x in e)
            return Val("list", items=items, total=True) if items else Val("nil", literal=[], total=True)
        return self.value(e)

    def symbol(self, name: str) -> Val:
        if name in ("true", "false", "nil"):
            return {"true": self.value(True), "false": Val("false"), "nil": Val("nil", literal=[], total=True)}[name]
        if name[:1] == "$" and name[1:] in VARIABLES:
            return self.row.variable(name[1:])
        if name[:1] == "&" and name[1:] in VARIABLES and self.other is not None:
            return self.other.variable(name[1:])
        raise DslError(f"unbound variable: {name}")

    def condition(self, e) -> Column:
        """``e`` as the condition of a filter, where NULL counts as false: bare comparisons, which reach the scan.

        In strict mode the order of the operands matters, so there it is the plain truth of the value.
        """
        if self.strict or not isinstance(e, list) or not e or not isinstance(e[0], Sym):
            return truth(self.value(e))
        name, args = e[0].name, e[1:]
        if name in ("and", "or") and args:
            self.value(e)  # the errors are those of the value
            return reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), [self.condition(x) for x in args])
        if name in BARE and len(args) == 2:
            self.value(e)
            x, y = (self.value(v) for v in args)
            cols = [v.raw if v.raw is not None else v.col for v in (x, y)]
            made = BARE[name](*[c.cast("double") for c in cols] if x.type != y.type else cols)
            for v in (x, y):
                if v.raw is not None:
                    made = made & (v.raw != 0)
            return made
        if name == "eq?" and len(args) == 2:
            x, y = (self.value(v) for v in args)
            if x.type == y.type and x.type in ("str", "int") and (x.literal is not None or y.literal is not None):
                return x.col == y.col
        if name == "member" and len(args) == 2:
            x, lst = (self.value(v) for v in args)
            if lst.items and x.col is not None and all(i.literal is not None and i.type == x.type for i in lst.items):
                return x.col.isin([i.literal for i in lst.items])
        return truth(self.value(e))

    # Each helper that needs a value of a type lives here, so errors read alike.
    def need(self, e, types: str, what: str) -> Val:
        v = self.value(e)
        if v.type not in types.split("|"):
            raise DslError(f"{what}: {write(e)} is {v.type}, wanted {types}")
        return v

    def guard(self, vals: list[Val], what: str, made: Column) -> Column:
        """In strict mode a NULL operand raises; the check shares the CASE with the result."""
        if not self.strict:
            return made
        for v in vals:
            if not v.total and v.col is not None:
                made = F.when(v.col.isNull(), F.raise_error(F.lit(f"wrong type argument: {what}"))).otherwise(made)
        return made

    def unify(self, vals: list[Val], whens: list[Column | None]) -> Val:
        """A CASE over values; #f and missing values fit every type."""
        kinds = {v.type for v in vals if v.type != "false"}
        if kinds == {"int", "real"}:
            kinds = {"real"}
        if kinds == {"nil", "list"}:
            kinds = {"list"}
        if len(kinds) > 1:
            # Values of several types: as a condition each is its own truth; as text each prints itself.
            return Val("mixed", items=tuple(vals), literal=tuple(whens))
        kind = kinds.pop() if kinds else "false"
        if kind in ("false", "nil", "regex"):
            return vals[0] if kind != "false" else Val("false")
        out: Column | None = None
        default = F.lit(False) if kind == "bool" else F.lit(None).cast(_spark_type(kind))
        for w, v in zip(whens, vals, strict=True):
            c = default if v.type == "false" else (self.as_array(v) if kind == "list" else v.col)
            if w is None:
                return Val(kind, c if out is None else out.otherwise(c))
            out = F.when(w, c) if out is None else out.when(w, c)
        return Val(kind, out.otherwise(default))

    def as_array(self, v: Val) -> Column:
        if v.col is not None:
            return v.col
        return F.array(*[x.col.cast("string") for x in v.items]) if v.items else F.array().cast("array<string>")

    def match(self, regex: Val, args: list) -> Val:
        if not 1 <= len(args) <= 3:
            raise DslError("a pattern takes a string, a group and a default")
        target = self.need(args[0], "str", "pattern")
        if regex.col is not None:
            pattern = regex.col
            hit = F.regexp_like(target.col, pattern)
        else:
            text = to_java(regex.literal.pattern, regex.literal.icase)
            pattern = F.lit(text)
            hit = target.col.rlike(text)
        if len(args) == 1:
            return Val("bool", self.guard([target], "pattern", F.coalesce(hit, F.lit(False))), total=True)
        group = self.need(args[1], "int", "group")
        if group.literal is None or group.literal < 1:
            raise DslError("a group is a positive number")
        default = self.value(args[2]) if len(args) == 3 else Val("str", F.lit(""), total=True)
        if default.type not in ("str", "false"):
            raise DslError("the default of a group is a string")
        none = F.lit(None).cast("string") if default.type == "false" else default.col
        return Val("str", F.when(hit, F.regexp_extract(target.col, text, group.literal) if regex.col is None else F.regexp_substr(target.col, pattern)).otherwise(none))


def _spark_type(kind: str) -> str:
    return {"bool": "boolean", "int": "long", "real": "double", "str": "string", "list": "array<string>"}[kind]


def _arity(name: str, args: list, least: int, most: int | None = None) -> None:
    if len(args) < least or (most is not None and len(args) > most):
        raise DslError(f"{name}: wrong number of arguments: {len(args)}")


def _begin(c: Compiler, a: list) -> Val:
    _arity("begin", a, 1)
    return [c.value(x) for x in a][-1]


def _begin0(c: Compiler, a: list) -> Val:
    _arity("begin0", a, 1)
    return [c.value(x) for x in a][0]


def truth(v: Val) -> Column:
    if v.type != "mixed":
        return v.truthy()
    out: Column | None = None
    for w, x in zip(v.literal, v.items, strict=True):
        if w is None:
            return truth(x) if out is None else out.otherwise(truth(x))
        out = F.when(w, truth(x)) if out is None else out.when(w, truth(x))
    return out.otherwise(F.lit(False))


def _and(c: Compiler, a: list) -> Val:
    if not a:
        return c.value(True)
    vals = [c.value(x) for x in a]
    # The first false operand decides; CASE keeps that order, AND would not.
    return c.unify([Val("false")] * (len(vals) - 1) + [vals[-1]], [~truth(v) for v in vals[:-1]] + [None])


def _or(c: Compiler, a: list) -> Val:
    if not a:
        return Val("false")
    vals = [c.value(x) for x in a]
    return c.unify(vals, [truth(v) for v in vals[:-1]] + [None])


def _if(c: Compiler, a: list) -> Val:
    _arity("if", a, 3, 3)
    return c.unify([c.value(a[1]), c.value(a[2])], [truth(c.value(a[0])), None])


def _cond(c: Compiler, a: list) -> Val:
    vals, whens = [], []
    for clause in a:
        if not isinstance(clause, list) or not clause:
            raise DslError("cond: a clause is a list")
        test = c.value(clause[0])
        vals.append(c.value(clause[-1]) if len(clause) > 1 else test)
        whens.append(truth(test))
    return c.unify([*vals, Val("false")], [*whens, None])


def _not(c: Compiler, a: list) -> Val:
    _arity("not", a, 1, 1)
    return Val("bool", ~truth(c.value(a[0])), total=True)


def _eq(c: Compiler, a: list) -> Val:
    _arity("eq?", a, 2, 2)
    x, y = c.value(a[0]), c.value(a[1])
    if x.type == "false" or y.type == "false":
        return Val("bool", ~truth(x) & ~truth(y), total=True)
    if x.type != y.type:
        # Two missing values are both #f, whatever their types.
        both = F.lit(False) if x.col is None or y.col is None or x.total or y.total else x.col.isNull() & y.col.isNull()
        return Val("bool", both, total=True)
    if x.type in ("nil", "regex"):
        return c.value(x.literal == y.literal) if x.literal == y.literal else Val("bool", F.lit(False), total=True)
    p, q = (c.as_array(x), c.as_array(y)) if x.type == "list" else (x.col, y.col)
    return Val("bool", p.eqNullSafe(q), total=True)


def _compare(name: str, f: Callable[[Column, Column], Column]):
    def op(c: Compiler, a: list) -> Val:
        _arity(name, a, 2, 2)
        x, y = (c.need(v, "int|real", name) for v in a)
        made = F.coalesce(f(x.col.cast("double") if x.type != y.type else x.col, y.col.cast("double") if x.type != y.type else y.col), F.lit(False))
        return Val("bool", c.guard([x, y], name, made), total=True)

    return op


def _strings(name: str, f: Callable[[Column, Column], Column]):
    def op(c: Compiler, a: list) -> Val:
        _arity(name, a, 2, 2)
        x, y = (c.need(v, "str", name) for v in a)
        return Val("bool", c.guard([x, y], name, F.coalesce(f(x.col, y.col), F.lit(False))), total=True)

    return op


def _member(c: Compiler, a: list) -> Val:
    _arity("member", a, 2, 2)
    x, lst = c.value(a[0]), c.value(a[1])
    if lst.type == "nil":
        return Val("false")
    if lst.type != "list":
        raise DslError("member: the second argument is a list")
    if x.col is None:
        return Val("false")
    fit = [i for i in lst.items if i.type == x.type]
    if lst.items:
        if not fit:
            return Val("false")
        items = c.as_array(lst)
        hit = reduce(lambda p, q: p | q, [x.col.eqNullSafe(i.col) for i in fit])
        at = F.array_position(items, x.col.cast("string"))
        return Val("list", F.when(hit, F.slice(items, at.cast("int"), F.size(items))))
    at = F.array_position(lst.col, x.col.cast("string"))
    return Val("list", F.when(at > 0, F.slice(lst.col, at.cast("int"), F.size(lst.col))))


def _list(c: Compiler, a: list) -> Val:
    vals = tuple(c.value(x) for x in a)
    return Val("list", items=vals, total=True) if vals else Val("nil", literal=[], total=True)


def _fold_case(f: Callable[[Column], Column]):
    def op(c: Compiler, a: list) -> Val:
        _arity("case", a, 1, 1)
        v = c.value(a[0])
        if v.type == "str":
            return Val("str", f(v.col), total=v.total)
        if v.type == "list":
            if v.col is not None:
                return Val("list", F.transform(v.col, f))
            return Val("list", items=tuple(Val("str", f(x.col), total=x.total) if x.type == "str" else x for x in v.items), total=True)
        return v

    return op


def _tr(c: Compiler, a: list) -> Val:
    _arity("tr", a, 2, 2)
    v = c.value(a[0])
    pair = c.need(a[1], "str", "tr")
    if v.type != "str":
        return v
    if not isinstance(pair.literal, str) or len(pair.literal.encode()) != 2:
        raise DslError("tr: the second argument has two characters")
    return Val("str", F.translate(v.col, pair.literal[0], pair.literal[1]), total=v.total)


def _length(c: Compiler, a: list) -> Val:
    _arity("length", a, 1, 1)
    v = c.need(a[0], "str", "length")
    return Val("int", c.guard([v], "length", F.octet_length(v.col).cast("long")), total=v.total)


def _arith(name: str, f: Callable[[Column, Column], Column]):
    def op(c: Compiler, a: list) -> Val:
        _arity(name, a, 2, 2)
        x, y = (c.need(v, "int", name) for v in a)
        return Val("int", c.guard([x, y], name, f(x.col, y.col)), total=x.total and y.total)

    return op


def _concat(c: Compiler, a: list) -> Val:
    vals = [c.need(x, "str", "concat") for x in a]
    if not vals:
        return c.value("")
    return Val("str", c.guard(vals, "concat", F.concat(*[v.col for v in vals])), total=all(v.total for v in vals), literal="".join(v.literal for v in vals) if all(isinstance(v.literal, str) for v in vals) else None)


def _to_regexp(c: Compiler, a: list) -> Val:
    _arity("string->regexp", a, 1, 3)
    v = c.need(a[0], "str", "string->regexp")
    fold = False
    if len(a) > 1:
        if len(a) != 3 or a[1] != Sym(":case-fold"):
            raise DslError("string->regexp: :case-fold takes a value")
        fold = not (a[2] is False or a[2] == Sym("false"))
    if isinstance(v.literal, str):
        return Val("regex", literal=Regex(v.literal, fold), total=True)
    return Val("regex", F.concat(F.lit("(?mi)" if fold else "(?m)"), v.col))


def _quote(c: Compiler, a: list) -> Val:
    _arity("regexp-quote", a, 1, 1)
    v = c.need(a[0], "str", "regexp-quote")
    if isinstance(v.literal, str):
        return c.value("".join("\\" + ch if ch in "[{.*+]}^$()|?\\" else ch for ch in v.literal))
    return Val("str", F.regexp_replace(v.col, r"[\[{.*+\]}^$()|?\\]", r"\\$0"), total=v.total)


def _dollar(c: Compiler, a: list) -> Val:
    return _field(c.row, c, a, "$")


def _ampersand(c: Compiler, a: list) -> Val:
    if c.other is None:
        raise DslError("& stands in sorters only")
    return _field(c.other, c, a, "&")


def _field(row: Row, c: Compiler, a: list, name: str) -> Val:
    _arity(name, a, 1, 2)
    if not isinstance(a[0], str):
        raise DslError(f"{name}: the field is a string")
    v = row.dollar(a[0])
    if len(a) == 1 or a[1] == []:
        return v
    d = c.value(a[1])
    if d.type == v.type:
        return Val(v.type, F.coalesce(v.col, d.col), total=d.total)
    return c.unify([v, d], [v.col.isNotNull(), None])


def _null(c: Compiler, a: list) -> Val:
    _arity("null?", a, 1, 1)
    v = c.value(a[0])
    if v.type == "list" and v.col is not None:
        return Val("bool", F.coalesce(F.size(v.col) == 0, F.lit(False)), total=True)
    return c.value(True) if v.type == "nil" else Val("bool", F.lit(False), total=True)


def _print(c: Compiler, a: list) -> Val:
    _arity("print", a, 1, 1)
    return c.value(a[0])


OPERATORS: dict[str, Callable[[Compiler, list], Val]] = {
    "null?": _null,
    "begin": _begin,
    "begin0": _begin0,
    "and": _and,
    "or": _or,
    "if": _if,
    "cond": _cond,
    "not": _not,
    "eq?": _eq,
    "<": _compare("<", lambda x, y: x < y),
    ">": _compare(">", lambda x, y: x > y),
    "<=": _compare("<=", lambda x, y: x <= y),
    ">=": _compare(">=", lambda x, y: x >= y),
    "prefix?": _strings("prefix?", lambda x, y: F.startswith(x, y)),
    "suffix?": _strings("suffix?", lambda x, y: F.endswith(x, y)),
    "substr?": _strings("substr?", lambda x, y: F.contains(x, y)),
    "member": _member,
    "list": _list,
    "downcase": _fold_case(ascii_lower),
    "upcase": _fold_case(ascii_upper),
    "tr": _tr,
    "length": _length,
    "+": _arith("+", lambda x, y: x + y),
    "-": _arith("-", lambda x, y: x - y),
    "string-append": _concat,
    "concat": _concat,
    "string->regexp": _to_regexp,
    "regexp-quote": _quote,
    "print": _print,
    "printX": _print,
    "$": _dollar,
    "&": _ampersand,
}


#: Operators whose bare form serves as a condition.
BARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda x, y: x < y,
    ">": lambda x, y: x > y,
    "<=": lambda x, y: x <= y,
    ">=": lambda x, y: x >= y,
    "prefix?": lambda x, y: F.startswith(x, y),
    "suffix?": lambda x, y: F.endswith(x, y),
    "substr?": lambda x, y: F.contains(x, y),
}


def filter_column(exp: str, row: Row, strict: bool = False) -> Column:
    """The condition of ``-Q``: true where the value is not ``#f``; NULL counts as false, as in any filter."""
    return Compiler(row, strict=strict).condition(read(exp))


def format_column(exp: str, row: Row, strict: bool = False) -> Column:
    """The text of ``-F``: strings and integers as they are, ``#t`` a line end, ``#f`` nothing, lists in turn."""
    return _printed(Compiler(row, strict=strict).value(read(exp)))


def _printed(v: Val) -> Column:
    if v.type == "false" or v.type == "nil":
        return F.lit("")
    if v.type == "mixed":
        out: Column | None = None
        for w, x in zip(v.literal, v.items, strict=True):
            if w is None:
                return _printed(x) if out is None else out.otherwise(_printed(x))
            out = F.when(w, _printed(x)) if out is None else out.when(w, _printed(x))
        return out.otherwise(F.lit(""))
    if v.type == "bool":
        return F.when(v.col, F.lit("\n")).otherwise(F.lit(""))
    if v.type in ("str", "int"):
        return F.coalesce(v.col.cast("string"), F.lit(""))
    if v.type == "list":
        if v.col is not None:
            return F.coalesce(F.array_join(v.col, ""), F.lit(""))
        parts = []
        for x in v.items:
            if x.type == "nil":  # printing stops at an empty list
                break
            parts.append(_printed(x))
        return F.concat(*parts) if parts else F.lit("")
    raise DslError(f"a {v.type} cannot be printed")


# --- sorter -------------------------------------------------------------------------------------


def _renamed(e):
    """``&x`` as ``$x``, ``(& k)`` as ``($ k)``."""
    if isinstance(e, Sym) and e.name[:1] == "&":
        return Sym("$" + e.name[1:])
    return [_renamed(x) for x in e] if isinstance(e, list) else e


def _mentions_other(e) -> bool:
    if isinstance(e, Sym):
        return e.name[:1] == "&"
    return isinstance(e, list) and any(map(_mentions_other, e))


def sort_keys(e) -> list[tuple[object, bool]] | None:
    """The keys (expression, ascending) that a comparator orders by; None if it has no such form."""
    if not isinstance(e, list) or not e or not isinstance(e[0], Sym):
        return None
    name = e[0].name
    if name == "<>" and len(e) == 3:
        if not _mentions_other(e[1]) and _mentions_other(e[2]) and _renamed(e[2]) == e[1]:
            return [(e[1], True)]
        if not _mentions_other(e[2]) and _mentions_other(e[1]) and _renamed(e[1]) == e[2]:
            return [(e[2], False)]
        return None
    if name == "*-" and len(e) == 2:
        keys = sort_keys(e[1])
        return None if keys is None else [(k, not up) for k, up in keys]
    if name == "<or>":
        parts = [sort_keys(x) for x in e[1:]]
        return None if any(p is None for p in parts) else [k for p in parts for k in p]
    return None


def order_columns(exp: str, row: Row) -> list[Column] | None:
    """Sort orders for ``orderBy``; None where the comparator needs both rows at once."""
    keys = sort_keys(read(exp))
    if keys is None:
        return None
    c = Compiler(row)
    out = []
    for e, up in keys:
        v = c.value(e)
        if v.type == "bool":  # two truth values always compare equal
            continue
        if v.type not in ("int", "real", "str"):
            raise DslError(f"<>: {write(e)} cannot be compared")
        out.append(v.col.asc_nulls_first() if up else v.col.desc_nulls_last())
    return out


class _Comparator(Compiler):
    """Adds the three comparing operators; values are -1, 0, 1."""

    def value(self, e) -> Val:
        if isinstance(e, list) and e and isinstance(e[0], Sym) and e[0].name in ("<>", "*-", "<or>"):
            name, args = e[0].name, [self.value(x) for x in e[1:]]
            if name == "<>":
                a, b = args
                if a.type == "bool" and b.type == "bool":
                    return Val("int", F.lit(0).cast("long"), total=True)
                if a.type != b.type and {a.type, b.type} != {"int", "real"}:
                    raise DslError("<>: both sides have one type")
                less = F.coalesce(a.col < b.col, b.col.isNotNull() & a.col.isNull())
                more = F.coalesce(a.col > b.col, a.col.isNotNull() & b.col.isNull())
                return Val("int", F.when(less, -1).when(more, 1).otherwise(0).cast("long"), total=True)
            if any(v.type != "int" for v in args):
                raise DslError(f"{name}: wants integers")
            if name == "*-":
                return Val("int", -args[0].col, total=True)
            out: Column | None = None
            for v in args[:-1]:
                w = v.col.isin(-1, 1)
                out = F.when(w, v.col) if out is None else out.when(w, v.col)
            return Val("int", args[-1].col if out is None else out.otherwise(args[-1].col), total=True)
        return super().value(e)


def comparator(exp: str, columns: Mapping[str, str], fields: str | None = None) -> Callable[[Column, Column], Column]:
    """A comparator of two structs; ``columns`` maps variables to field names of the structs."""
    e = read(exp)

    def cmp(a: Column, b: Column) -> Column:
        rows = [Row({k: x.getField(v) for k, v in columns.items()}, x.getField(fields) if fields else None) for x in (a, b)]
        v = _Comparator(rows[0], rows[1]).value(e)
        if v.type != "int":
            raise DslError("a sorter gives an integer")
        return F.coalesce(v.col, F.lit(0)).cast("int")

    return cmp


#: Rows that one task sorts by a comparator without keys.
BUCKET_ROWS = 20_000
MOST_SPLITTERS = 1 << 14


def sort_entries(df: DataFrame, exp: str, columns: Mapping[str, str], fields: str | None = None) -> DataFrame:
    """``df`` in the order of the sorter ``exp``; ``columns`` maps variables to column names.

    A comparator made of keys becomes ``orderBy``. Any other is sorted in buckets: rows are compared with
    splitters drawn from the rows, so that a bucket holds about ``BUCKET_ROWS``; rows that compare equal
    are told apart by a hash, so ties do not gather in one bucket.
    """
    orders = order_columns(exp, Row(columns, fields))
    if orders is not None:
        return df.orderBy(*orders) if orders else df
    names = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names], F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))]).alias("_tie"))
    base = comparator(exp, columns, fields)

    def cmp(a: Column, b: Column) -> Column:
        c = base(a, b)
        tie = F.when(a.getField("_tie") < b.getField("_tie"), -1).when(a.getField("_tie") > b.getField("_tie"), 1).otherwise(0)
        return F.when(c != 0, c).otherwise(tie).cast("int")

    rows = df.select(row.alias("r"))
    n = min(MOST_SPLITTERS, rows.count() // BUCKET_ROWS)
    if n:
        # At most MOST_SPLITTERS * 8 rows, drawn by their hash.
        drawn = rows.orderBy(F.xxhash64(F.col("r._tie"))).limit(n * 8)
        chosen = drawn.agg(F.array_sort(F.collect_list("r"), cmp).alias("s"))
        chosen = chosen.select(F.transform(F.sequence(F.lit(4), F.lit(n * 8 - 1), F.lit(8)), lambda i: F.get(F.col("s"), i)).alias("s"))
        rows = rows.crossJoin(F.broadcast(chosen))  # one row of bounded size
        # The place among the splitters by halving: a row is compared log2(n) times.
        rows = rows.withColumn("b", F.lit(0))
        for k in reversed(range(int(n).bit_length())):
            s = F.get(F.col("s"), F.col("b") + (1 << k) - 1)
            rows = rows.withColumn("b", F.col("b") + F.when(s.isNotNull() & (cmp(F.col("r"), s) > 0), 1 << k).otherwise(0))
        rows = rows.select("r", "b")
    else:
        rows = rows.select("r", F.lit(0).alias("b"))
    sorted_ = rows.groupBy("b").agg(F.array_sort(F.collect_list("r"), cmp).alias("rs"))
    flat = sorted_.select("b", F.posexplode("rs").alias("p", "r")).orderBy("b", "p")
    return flat.select(*[F.col(f"r.`{c}`").alias(c) for c in names])
