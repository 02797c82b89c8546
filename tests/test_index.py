"""Reading, writing, escaping, lookups and relations over small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from symloom.functions.escape import escape_name, unescape
from symloom.functions.patterns import search_pattern
from symloom.operators import scope, writers
from symloom.operators.rank import latest, ranked
from symloom.sources import files as sources
from symloom.sources.tags import Index, parse_ptags, parse_rows

LINES = [
    "!_TAG_FILE_SORTED\t1\t/0=unsorted/",
    "!_TAG_KIND_DESCRIPTION!C\tf,function\t/functions/",
    'foo\ta.c\t/^int foo(\\/*x*\\/)$/;"\tf\tline:3\tscope:a:b\tfile:',
    'b\\tr\tb.c\t12;"\tkind:v\tend:9\tkind:z',
    'c\td.c\t7;/^x$/;"\tm',
    "u\td.c\t/^never closed",
    "bad",
    "",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES] + [(None,)], "value string")


def test_rows(lines):
    got = {r.name: r for r in parse_rows(lines).collect()}
    assert set(got) == {"foo", "b\tr", "c", "u"}
    assert got["foo"].line == 3 and got["foo"].file and got["foo"].fields["scope"] == "a:b" and got["foo"].kind == "f"
    assert got["b\tr"].line == 12 and got["b\tr"].kind == "v"  # the first of equal keys counts
    assert got["c"].line == 7 and got["c"].pattern == "/^x$/"
    assert got["u"].pattern == "/^never closed" and got["u"].kind is None


def test_header(lines):
    got = {(r.ptag_name, r.parser): r.setting for r in parse_ptags(lines).collect()}
    assert got == {("_TAG_FILE_SORTED", None): "1", ("_TAG_KIND_DESCRIPTION", "C"): "f,function"}


def test_escapes(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\\\t\n\x01\x7f !é~x20") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "\\x41", "\\\\t", "!a", " b"]
    d = spark.createDataFrame([(x,) for x in texts], "v string")
    assert d.where(unescape(escape_name(F.col("v"))) != F.col("v")).count() == 0
    assert d.where(escape_name(F.col("v")).rlike(r"[\t\n]|^[ !]")).count() == 0
    assert [r[0] for r in spark.createDataFrame([("\\x41\\xFF\\q",), (None,)], "v string").select(unescape(F.col("v"))).collect()] == ["A\\xFF\\q", None]


def test_patterns(spark):
    texts = ["int a/b\\c$", "é" * 60, "x" * 95 + "é" + "yy", "x" * 200, "", "plain", "x" * 96, "漢" * 40]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "l string").select(writers.pattern_of(F.col("l"))).collect()]
    assert got == [search_pattern(x) for x in texts]
    assert got[0] == "/^int a\\/b\\\\c\\$$/" and not got[3].endswith("$/")


def test_write_and_read(spark):
    rows = [("a\tb", "x.c", "/^q$/", "f", 3, "s", True), ("!n", "y.c", "/^r$/", "v", None, None, False)]
    d = spark.createDataFrame(rows, "name string, input string, pattern string, kind string, line long, scope string, file boolean")
    back = parse_rows(d.select(writers.tags_line({c: F.col(c) for c in d.columns}).alias("value")))
    assert sorted((r.name, r.input, r.pattern, r.kind, r.line, r.file) for r in back.collect()) == sorted((a, b, c, k, n, f) for a, b, c, k, n, _, f in rows)


def test_other_writers(spark):
    d = spark.createDataFrame([("foo", "func", 3)], "n string, k string, l int")
    assert d.select(writers.xref_line("%-8N|%6K|%.2N|%3n%%", {"N": F.col("n"), "K": F.col("k"), "n": F.col("l")})).first()[0] == "foo     |  func|fo|  3%"
    assert d.select(writers.json_line({"name": F.col("n"), "line": F.col("l"), "none": F.lit(None).cast("string")})).first()[0] == '{"_type":"tag","name":"foo","line":3}'
    bad = spark.createDataFrame([("a\tb",), ("c",)], "name string")
    assert [r[0] for r in bad.where(writers.etags_writable({"name": F.col("name")})).collect()] == ["c"]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "input string, v int")
    new = spark.createDataFrame([("a", 9)], "input string, v int")
    assert sorted(tuple(r) for r in writers.append(old, new).collect()) == [("a", 9), ("b", 2)]


def test_index_file(spark, tmp_path):
    p = tmp_path / "tags"
    p.write_text("\n".join(x for x in LINES if x) + "\n")
    index = Index.open(spark, str(p))
    assert index.find("FO", prefix=True, ignore_case=True).count() == 1
    assert [r.text for r in index.query('(eq? $kind "f")', "(<> $name &name)", '(list $name "@" $line)').collect()] == ["foo@3"]
    index.save(str(tmp_path / "out"))
    assert Index.load(spark, str(tmp_path / "out")).find("c").count() == 1


def test_latest_and_ranked(spark):
    d = spark.createDataFrame([(1, 1, "a", 5), (1, 1, "b", 9), (1, 1, "b", 9), (1, 2, "c", 1), (None, 1, "n", 1)], "file_id int, entry_id int, v string, indexed_at int")
    assert sorted((r.file_id or 0, r.entry_id, r.v) for r in latest(d).collect()) == [(0, 1, "n"), (1, 1, "b"), (1, 2, "c")]
    rows = [(i * 7 % 50, i) for i in range(200)]
    r = ranked(spark.createDataFrame(rows, "k int, i int"), [F.col("k"), F.col("i")]).collect()
    assert [(x.k, x.i) for x in sorted(r, key=lambda x: x.rank)] == sorted(rows)


def test_scopes(spark):
    e = spark.createDataFrame([(1, 1, None, "a", "c"), (1, 2, 1, "b", "c"), (1, 3, 2, "f", "m"), (1, 4, 4, "loop", "m"), (2, 2, 1, "orphan", "m")], "file_id int, entry_id int, scope_id int, name string, kind string")
    got = {(r.file_id, r.entry_id): r.fqn for r in scope.qualified_names(e).collect()}
    assert got == {(1, 1): "a", (1, 2): "a.b", (1, 3): "a.b.f", (1, 4): "loop", (2, 2): "orphan"}
    seps = spark.createDataFrame([("c", "m", "::")], "parent_kind string, kind string, separator string")
    assert {r.entry_id: r.fqn for r in scope.qualified_names(e.where("file_id = 1"), seps).collect()}[3] == "a.b::f"
    chain = spark.createDataFrame([(1, i, i - 1 if i > 1 else None, f"n{i}", "c") for i in range(1, 26)], e.schema)
    assert {r.entry_id: r.fqn for r in scope.qualified_names(chain).collect()}[25] == ".".join(f"n{i}" for i in range(1, 26))


def test_enclosing_against_brute_force(spark):
    rng = random.Random(3)
    ents = [(f, i, lo := rng.randint(1, 300), lo + rng.randint(0, 120), f"e{i}") for f in (1, 2) for i in range(40)]
    pts = [(f, k, rng.randint(1, 450)) for f in (1, 2, 3) for k in range(60)]
    e = spark.createDataFrame(ents, "file_id int, entry_id int, line long, end long, name string")
    p = spark.createDataFrame(pts, "file_id int, p int, line_no long")
    want = {(f, k): max(((lo, i) for g, i, lo, hi, _ in ents if g == f and hi > lo and lo <= n <= hi), default=(0, None))[1] for f, k, n in pts}
    assert {(r.file_id, r.p): r.enclosing_id for r in scope.enclosing(p, e).collect()} == want


def test_paths_and_detection(spark):
    d = spark.createDataFrame([("./a//b/../c.pm",), ("/x/../../y",), ("..",), ("",), ("../../a",)], "path string")
    assert [r[0] for r in d.select(sources.fold_path(F.col("path"))).collect()] == ["a/c.pm", "/y", "..", ".", "../../a"]
    assert d.select(sources.canonical(F.lit("/w/p/x.c"), F.lit("/w/p"))).first()[0] == "x.c"
    m = spark.createDataFrame([("Perl", "extension", "pm"), ("Raku", "extension", "pm"), ("Make", "pattern", "[Mm]akefile")], "lang string, spec string, pattern_text string")
    f = spark.createDataFrame([("a.pm",), ("x/makefile",), ("none",), (None,)], "path string")
    assert [r.detected for r in sources.detect_by_name(f, m).orderBy(F.col("path").asc_nulls_last()).collect()] == ["Perl", None, "Make", None]
    t = spark.createDataFrame([("#!/usr/bin/env python3\n",), ("# -*- mode: ruby -*-\n",), ("x\n// vim: ft=cpp\n",), ("",)], "c string")
    assert [r[0] for r in t.select(sources.interpreter(F.col("c"))).collect()] == ["python", None, None, None]
    assert [r[0] for r in t.select(sources.editor_mode(F.col("c"))).collect()] == [None, "ruby", "cpp", None]
    h = 5381
    for b in "naïve".encode():
        h = (h * 33 + b) % 2**32
    assert t.limit(1).select(sources.djb2(F.lit("naïve"))).first()[0] == h


def test_scan(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n, c in (("a.c", "int a;\n"), ("a.o", "x"), ("d/b.c", "﻿int b;\n"), ("d/e/c.c", "int c;\n")):
        (tmp_path / n).write_text(c)
    got = {r.path.rsplit("/", 1)[1]: r.contents for r in sources.scan(spark, str(tmp_path), maxdepth=2).collect()}
    assert got == {"a.c": "int a;\n", "b.c": "int b;\n"}


def test_resolve_outward(spark):
    rng = random.Random(9)
    n = 60
    ents = [(f, i, rng.choice([None, *range(1, i)]) if i > 1 else None, rng.choice("abcd")) for f in (1, 2) for i in range(1, n)]
    refs = [(f, k, rng.choice([None, *range(1, n)]), rng.choice("abcde")) for f in (1, 2, 3) for k in range(80)]
    up = {(f, i): s for f, i, s, _ in ents}
    want = {}
    for f, k, s, name in refs:
        while True:
            own = [i for g, i, t, m in ents if g == f and t == s and m == name]
            if own:
                want[f, k] = max(own)
            if own or s is None or (f, s) not in up:
                break
            s = up[f, s]
    e = spark.createDataFrame(ents, "file_id int, entry_id int, scope_id int, name string")
    r = spark.createDataFrame(refs, "file_id int, ref_id int, scope_id int, name string")
    assert {(x.file_id, x.ref_id): x.target_id for x in scope.resolve(e, r).collect()} == want
    assert scope.resolve(e.limit(0), r).count() == 0


def test_line_queries_over_all_lines(spark, tmp_path):
    import re

    from symloom.plans.queries import queries

    lines = ["plain a/b$", "x" * 95 + "é" + "yy", "x" * 200, "漢" * 40, "Été  \t b ", "été", "Zebra", "zebra", "ÉTÉ", "_a", "a  　 b", "x" * 200]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda n: queries()[n](spark, str(tmp_path)).collect()
    assert sorted((r.line_no, r.pattern) for r in run("pattern_column")) == [(i, search_pattern(x)) for i, x in enumerate(lines, 1)]
    assert sorted((r.line_no, r.compact) for r in run("compact_line")) == [(i, re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ")) for i, x in enumerate(lines, 1)]
    upper = lambda x: re.sub("[a-z]+", lambda m: m.group().upper(), x).encode()
    assert [r.line for r in sorted(run("sort_foldcase"), key=lambda r: r["rank"])] == sorted(set(lines), key=lambda x: (upper(x), x.encode()))


def test_deep_and_looping_scopes(spark):
    rows = [(1, i, i - 1 if i > 1 else None, f"n{i}", "c") for i in range(1, 151)] + [(2, 1, 2, "a", "c"), (2, 2, 1, "b", "c"), (2, 3, 2, "in", "c"), (2, 4, None, "top", "c"), (2, 5, 4, "x", "c")]
    e = spark.createDataFrame(rows, "file_id int, entry_id int, scope_id int, name string, kind string")
    got = {(r.file_id, r.entry_id): r.fqn for r in scope.qualified_names(e).collect()}
    assert got[1, 150] == ".".join(f"n{i}" for i in range(1, 151))
    assert got[2, 1] == "a" and got[2, 3] == "in" and got[2, 5] == "top.x"
    up = scope.ancestors(e)
    assert up.where("file_id = 1 AND entry_id = 150").count() == 151
    assert up.where("file_id = 2 AND entry_id = 3").count() == 3
    refs = spark.createDataFrame([(1, 7, 150, "n1")], "file_id int, ref_id int, scope_id int, name string")
    assert [r.target_id for r in scope.resolve(e, refs).collect()] == [1]
    assert scope.qualified_names(e.limit(0)).count() == 0


def test_streaming_index_keeps_and_orders(spark, tmp_path):
    from symloom.operators.languages import REGISTRY
    from symloom.streaming.ingest import StreamIndexer

    schema = "file_id long, path string, contents string, lang string, seq long"
    put = lambda *rows: spark.createDataFrame(list(rows), schema)
    index = StreamIndexer(spark, REGISTRY, str(tmp_path / "index"), key="file_id", parts=4)
    names = lambda: sorted((r.file_id, r.name) for r in index.entries().collect())
    c = lambda n: f"int {n} (void)\n{{\n}}\n"
    index.update(put((1, "a.c", c("one"), "C", 5), (2, "a.c", c("two"), "C", 5), (3, "b.c", "", "C", 9), (1, "a.c", c("old"), "C", 2)))
    assert names() == [(1, "one"), (2, "two")]
    index.update(put((1, "a.c", c("late"), "C", 4), (3, "b.c", c("early"), "C", 8), (4, "d.c", c("four"), "C", 1), (4, "d.c", c("four"), "C", 1)))
    assert names() == [(1, "one"), (2, "two"), (4, "four")]
    index.update(put((1, "a.c", c("newer"), "C", 6)))
    assert names() == [(1, "newer"), (2, "two"), (4, "four")]
    broken = StreamIndexer(spark, REGISTRY, "nosuchscheme://x/index", key="file_id")
    with pytest.raises(Exception):
        broken.update(put((9, "a.c", c("x"), "C", 1)))
    assert names() == [(1, "newer"), (2, "two"), (4, "four")]


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from symloom import storage

    s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(s)
