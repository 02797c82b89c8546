"""The compiler against a small interpreter of the query language, and the sorter against its comparator."""

import re
from functools import cmp_to_key

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symloom.functions.dsl import Row, filter_column, format_column, order_columns, sort_entries
from symloom.functions.regex import to_java
from symloom.functions.sexpr import DslError, Regex, Sym, read, write

ROWS = [
    ("foo", "f", 10, "class:A::B", True, {"end": "20", "x": "y"}),
    ("Bar", "v", 0, None, False, {"end": "zz"}),
    ("foobar", "m", 5, "struct:", None, None),
    ("", "f", None, "noColon", True, {}),
    ("éa", None, 7, None, False, {"end": "7"}),
]
SCHEMA = "name string, kind string, line int, scope string, file boolean, fields map<string,string>"
COLUMNS = {"name": "name", "kind": "kind", "line": "line", "scope": "scope", "file": "file"}
ROW = lambda: Row(COLUMNS, "fields")


def variable(r, name):
    d = dict(zip(("name", "kind", "line", "scope", "file"), r[:5], strict=True))
    f = r[5] or {}
    if name == "file":
        return bool(d["file"])
    if name == "line":
        return d["line"] or False
    if name == "end":
        v = f.get("end")
        return int(v) if v and re.fullmatch(r"\s*[+-]?\d+\s*", v) else False
    if name in ("scope-kind", "scope-name"):
        s = d["scope"]
        if not s or ":" not in s:
            return False
        k, v = s.split(":", 1)
        return k if name == "scope-kind" else (v or False)
    v = d.get(name, f.get(name))
    return False if v is None else v


def run(e, r):
    """The rules of the language, straight: only #f is false."""
    if isinstance(e, Sym):
        return {"true": True, "false": False}[e.name] if e.name in ("true", "false") else variable(r, e.name[1:])
    if not isinstance(e, list):
        return e
    op, a = e[0], e[1:]
    if isinstance(op, Regex):
        s = run(a[0], r)
        return s is not False and bool(re.search(op.pattern, s, re.M | (re.I if op.icase else 0)))
    name = op.name
    if name == "and":
        v = True
        for x in a:
            v = run(x, r)
            if v is False:
                return False
        return v
    if name == "or":
        for x in a:
            if (v := run(x, r)) is not False:
                return v
        return False
    if name == "not":
        return run(a[0], r) is False
    if name == "if":
        return run(a[1] if run(a[0], r) is not False else a[2], r)
    v = [run(x, r) for x in a]
    if name == "eq?":
        return type(v[0]) is type(v[1]) and v[0] == v[1]
    if any(x is False for x in v):
        return False
    if name in ("<", ">"):
        return v[0] < v[1] if name == "<" else v[0] > v[1]
    if name == "prefix?":
        return v[0].startswith(v[1])
    if name == "substr?":
        return v[1] in v[0]
    if name == "length":
        return len(v[0].encode())
    if name == "downcase":
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v[0])
    if name == "+":
        return v[0] + v[1]
    raise AssertionError(name)


strings = st.sampled_from([Sym("$name"), Sym("$kind"), Sym("$scope-name"), "foo", "f", ""]).flatmap(lambda s: st.sampled_from([s, [Sym("downcase"), s]]))
ints = st.sampled_from([Sym("$line"), Sym("$end"), 5, 7, 0]).flatmap(lambda i: st.sampled_from([i, [Sym("+"), i, 2]]))
atoms = st.one_of(
    st.tuples(st.sampled_from(["prefix?", "substr?", "eq?"]), strings, strings).map(lambda x: [Sym(x[0]), x[1], x[2]]),
    st.tuples(st.sampled_from(["<", ">", "eq?"]), ints, ints).map(lambda x: [Sym(x[0]), x[1], x[2]]),
    st.sampled_from([Sym("$file"), [Regex("^fo+", True), Sym("$name")], [Sym(">"), [Sym("length"), Sym("$name")], 2], True, False]),
)
exprs = st.recursive(atoms, lambda x: st.one_of(st.tuples(st.sampled_from(["and", "or"]), st.lists(x, min_size=1, max_size=3)).map(lambda t: [Sym(t[0]), *t[1]]), x.map(lambda e: [Sym("not"), e]), st.tuples(x, x, x).map(lambda t: [Sym("if"), *t])), max_leaves=5)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(es=st.lists(exprs, min_size=6, max_size=6))
def test_filter_agrees_with_interpreter(df, es):
    got = df.select(*[F.coalesce(filter_column(write(e), ROW()), F.lit(False)).alias(f"c{i}") for i, e in enumerate(es)]).collect()
    for r, g in zip(ROWS, got, strict=True):
        assert [run(e, r) is not False for e in es] == list(g), [write(e) for e in es]


@settings(max_examples=100, deadline=None)
@given(e=exprs)
def test_reader_gives_back_what_is_written(e):
    assert read(write(e)) == e


@pytest.mark.parametrize("bad", ["(", ")", "(foo 1)", "$nothing", "(< 1 \"a\")", "(eq? 1)", "(eq? 1 1) x", '(tr $name "abc")', "(& \"k\")", "(member 1 2)"])
def test_errors(df, bad):
    with pytest.raises(DslError):
        filter_column(bad, ROW())


def test_strict_raises_on_missing_values(df):
    assert df.where(filter_column("(> $line 1)", ROW())).count() == 3
    with pytest.raises(Exception, match="wrong type argument"):
        df.where(filter_column("(> $line 1)", ROW(), strict=True)).collect()


def test_formatter(df):
    got = [r[0] for r in df.select(format_column('(list (if $file "s" #f) $name ":" $line (list) "never" )', ROW())).collect()]
    assert got == ["sfoo:10", "Bar:", "foobar:5", "s:", "éa:7"]


def test_groups_and_defaults(df):
    got = [r[0] for r in df.select(format_column('(list (#/(o+)b/ $name 1 "none") "|" ($ "x" "-"))', ROW())).collect()]
    assert got == ["none|y", "none|-", "oo|-", "none|-", "none|-"]


def test_java_patterns():
    assert to_java("[[:alpha:]_]+").endswith(r"[\p{Alpha}_]+")
    assert to_java("[^x]").endswith(r"[^x\n]")
    assert to_java("foo|foobar").endswith("foobar|foo")


def test_sorter_keys(df):
    assert [r.name for r in sort_entries(df.drop("fields"), "(<or> (<> $kind &kind) (*- (<> $name &name)))", COLUMNS).collect()] == ["éa", "foo", "", "foobar", "Bar"]
    assert order_columns("(<> $file &file)", ROW()) == []


def test_sorter_without_keys(spark):
    rows = [(f"n{i % 7}", "ab"[i % 2], i) for i in range(60)]
    d = spark.createDataFrame(rows, "name string, kind string, line int")
    e = '(if (eq? $kind &kind) (<> $line &line) (if (eq? $kind "b") -1 1))'
    got = [(r.kind, r.line) for r in sort_entries(d, e, {k: k for k in d.columns}).collect()]
    assert got == sorted(((k, i) for _, k, i in rows), key=cmp_to_key(lambda a, b: (a[1] > b[1]) - (a[1] < b[1]) if a[0] == b[0] else (-1 if a[0] == "b" else 1)))


def test_sorter_in_buckets(spark, monkeypatch):
    import symloom.functions.dsl as dsl

    monkeypatch.setattr(dsl, "BUCKET_ROWS", 40)
    rows = [("x" if i % 3 else f"n{i}", "ab"[i % 2], i % 5) for i in range(300)]  # a third and more are ties
    d = spark.createDataFrame(rows, "name string, kind string, line int")
    e = '(if (eq? $kind &kind) (<> $name &name) (if (eq? $kind "b") -1 1))'
    got = [(r.kind, r.name) for r in sort_entries(d, e, {k: k for k in d.columns}).collect()]
    assert got == sorted(((k, n) for n, k, _ in rows), key=lambda x: (x[0] != "b", x[1]))


def test_conditions_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("'n' || id as name", "'f' as kind", "cast(id as long) as line").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    row = Row({k: k for k in d.columns})
    plan = d.where(filter_column('(and (eq? $kind "f") (prefix? $name "n") (> $line 3))', row)).select("name")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,f), StringStartsWith(name,n), Gr" in plan  # the list is cut in print


def test_empty_table(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert d.where(filter_column("(> $line 1)", ROW())).count() == 0
    assert sort_entries(d.drop("fields"), "(<> $name &name)", COLUMNS).count() == 0
