"""Rules, machines, guests, scripts, option files and built-in languages on hand-written sources."""

import pytest
from pyspark.sql import functions as F

from symloom.functions.script import Machine, ScriptError, Str, compile_script, repr_of
from symloom.operators.extract import extract_entries, extract_text, line_entries, lines_of, qualify
from symloom.operators.languages import COVERED, REGISTRY
from symloom.operators.spec import Rule, to_python
from symloom.sources.options import OptionError, Options


def names(lang, text, registry=REGISTRY, kinds=False):
    spec = registry.get(lang)
    e = extract_text(spec, "input", text, registry)
    qualify(e, spec)
    return [(x["kind"], x["name"]) if kinds else (x["name"], x["line"]) for x in e]


def scoped(lang, text):
    spec = REGISTRY.get(lang)
    e = extract_text(spec, "input", text, REGISTRY)
    qualify(e, spec)
    return {x["name"]: x.get("scope_name") for x in e}


SAMPLES = {
    "C": ("#define A 1\nstruct s {\n  int m;\n  char *q;\n};\nstatic int f (int a)\n{\n  return a;\n}\n/* int no (void) { } */\n#if 0\nint no2 (void)\n{\n}\n#endif\nint v = 3;\n", {"A", "s", "m", "q", "f", "v"}),
    "Python": ("import os\nclass C(object):\n    def m(self, a=(1, 2)):\n        pass\n\ndef f():\n    '''def no(): '''\n    return 1\nV = 2\n", {"C", "m", "f", "V", "os"}),
    "Protobuf": ("package a.b;\nmessage M {\n  optional int32 x = 1; // int32 no = 2;\n  enum E { Z = 0; }\n}\nservice S { rpc R (M) returns (M); }\n", {"a.b", "M", "x", "E", "S", "R"}),
    "Thrift": ("namespace java q\nstruct T {\n  1: required map<string, i32> f,\n}\nservice V {\n  # void no()\n  oneway void g(1: i32 a),\n}\n", {"q", "T", "f", "V", "g"}),
    "EmacsLisp": ("(defvar a 1)\n;; (defun no ())\n(defun b (x)\n  \"Doc (defun no2 ()).\"\n  x)\n(defmacro c () nil)\n", {"a", "b", "c"}),
    "Perl": ("package P::Q;\nsub s1 {\n}\n=head1 X\n\nsub no {\n\n=cut\n", {"P::Q", "s1"}),
    "Raku": ("class K {\n  method m($x) { }\n  token t { \\d+ }\n}\n", {"K", "m", "t"}),
    "XSLT": ('<xsl:template match="a/b"><!-- <xsl:param name="no"/> --></xsl:template>\n<xsl:template name="t"><xsl:param name="p"/></xsl:template>', {"a/b", "t", "p"}),
    "Go": ("package main\nfunc F(a int) int {\n\treturn 1\n}\ntype S struct {\n\tx int\n}\nfunc (s *S) M() {\n}\n", {"main", "F", "S", "x", "M"}),
    "Rust": ("mod m {\n    pub fn f(x: i32) -> i32 { x }\n}\nstruct S;\nimpl S {\n    fn g(&self) {}\n}\n", {"m", "f", "S", "g"}),
    "Java": ("package p;\npublic class C {\n  private int x;\n  public void m(int a) {\n  }\n}\n", {"p", "C", "x", "m"}),
    "JavaScript": ("function f(a) { }\nclass C {\n  m(x) {\n  }\n}\nconst g = (a) => { };\nvar v = 1;\n", {"f", "C", "m", "g", "v"}),
    "Ruby": ("module M\n  class C\n    def m(a)\n    end\n  end\nend\n", {"M", "C", "m"}),
    "Sh": ("f() {\n}\nfunction g {\n}\nalias ll='ls'\n", {"f", "g", "ll"}),
    "Lua": ("function a.b(x)\nend\nlocal c = function() end\n", {"a.b", "c"}),
    "SQL": ("CREATE TABLE t (a int);\ncreate or replace view v as select 1;\n-- create table no (a int)\n", {"t", "v"}),
    "Make": ("A = 1\nall: x y\n\techo\ninclude foo.mk\n", {"A", "all", "foo.mk"}),
    "Iniconf": ("[s]\nk = v\n; no = 1\n[t]\n", {"s", "k", "t"}),
    "JSON": ('{"a": {"b": [1, "x"]}, "c": null}', {"a", "b", "c", "0", "1"}),
    "TOML": ("[t]\nk = 1\n[[arr]]\n", {"t", "k", "arr"}),
    "Tex": ("\\section{One}\n\\label{l1}\n\\subsection{Two}\n", {"One", "l1", "Two"}),
    "Markdown": ("# A\ntext\n## B\n```\n# no\n```\nT\n===\n[^f]: note\n", {"A", "B", "T", "f"}),
    "ReStructuredText": ("Title\n=====\n\nSub\n---\n\n.. _tgt: x\n", {"Title", "Sub", "tgt"}),
    "CSS": (".a, #b { color: red }\nh1 { }\n", {"a", "b", "h1"}),
    "YACC": ("%token NUM\n%{\nint helper (void)\n{\n  return 1;\n}\n%}\nexpr: NUM ;\n", {"NUM", "expr", "helper"}),
}


@pytest.mark.parametrize("lang", SAMPLES)
def test_language(lang):
    text, want = SAMPLES[lang]
    got = {n for n, _ in names(lang, text)}
    assert want <= got and not any(n.startswith("no") and n != "node" for n in got - {"note"}), got


@pytest.mark.parametrize("lang", COVERED)
@pytest.mark.parametrize("text", ["", "\n", "{{{{((((", '"', "/*", "﻿x", "\x00\xff" * 50, "a" * 5000, "<a><b", "[[[", "def f(\nclass {\nend\n" * 20])
def test_every_language_survives(lang, text):
    for e in extract_text(REGISTRY.get(lang), "p", text, REGISTRY):
        assert e["name"] and e["line"] >= 1


def test_scopes():
    assert scoped("C", SAMPLES["C"][0])["m"] == "s"
    assert scoped("Python", SAMPLES["Python"][0])["m"] == "C"
    assert scoped("Thrift", SAMPLES["Thrift"][0])["g"] == "V"
    assert scoped("Ruby", SAMPLES["Ruby"][0])["m"] == "M.C"
    assert scoped("Markdown", SAMPLES["Markdown"][0])["B"] == "A"


def test_html_and_guests():
    t = '<html><title>A <b>b</b></title>\n<h1 class="x y" id="i">T</h1><h2>un<b>closed</h2>\n<script>\nfunction f() {}\n</script></html>'
    got = set(names("HTML", t, kinds=True))
    assert {("title", "A b"), ("heading1", "T"), ("id", "i"), ("class", "x"), ("function", "f")} <= got
    assert ("f", 4) in names("HTML", t)


OPTIONS = r"""
# a language of sections and items
--langdef=Tiny
--map-Tiny=.tiny(Tiny*)
--kinddef-Tiny=s,section,sections
--kinddef-Tiny=i,item,items
--regex-Tiny=/^\[([a-z]+)\]$/\1/s/{scope=set}{exclusive}
--regex-Tiny=/^([a-z]+)=(.*)$/\1/i/{scope=ref}{_field=value:\2}
--_fielddef-Tiny=value,the value
--_scopesep-Tiny={section}/{item}:::
--mline-regex-Tiny=/begin\n([a-z]+)/\1/b,block,blocks/{mgroup=1}
--_roledef-Tiny.{item}=used,used items
--regex-Tiny=/^use ([a-z]+)$/\1/i/{_role=used}
--kinds-Tiny=-b
--sort=foldcase
"""


def test_option_file(spark):
    o = Options().read(OPTIONS)
    spec = o.registry.get("tiny")
    assert o.settings.sort == "foldcase" and spec.extensions == ("tiny",) and spec.patterns == ("Tiny*",)
    assert not spec.kind("b").enabled and spec.kind("i").roles == ("used",)
    files = spark.createDataFrame([(1, "a.tiny", "[x]\nk=v\nuse q\nbegin\nw\n[y]\nk=2\n", "Tiny"), (2, "b", None, "Tiny"), (3, "c", "[x]", None), (4, None, "", "Tiny")], "file_id int, path string, contents string, lang string")
    rows = extract_entries(files, o.registry).orderBy("file_id", "line").collect()
    assert [(r.name, r.kind, r.line, r.scope_name, r.end) for r in rows] == [("x", "section", 1, None, 5), ("k", "item", 2, "x", None), ("y", "section", 6, None, 7), ("k", "item", 7, "y", None)]
    assert rows[1].fields == {"value": "v"} and rows[1].pattern == "/^k=v$/"
    with_refs = extract_entries(files, o.registry, references=True)
    assert [(r.name, r.roles) for r in with_refs.where("line = 3").collect()] == [("q", ["used"])]
    assert extract_entries(files.limit(0), o.registry).count() == 0
    for bad in ("--regex-None=/a/b/", "nothing", "--_mtable-regex-Tiny=none/a/b/"):
        with pytest.raises(OptionError):
            Options(o.registry).apply(bad)


MACHINE = r"""
--langdef=Mach
--kinddef-Mach=f,func,functions
--kinddef-Mach=v,var,variables
--_tabledef-Mach=main
--_tabledef-Mach=comment
--_tabledef-Mach=body
--_mtable-regex-Mach=main/\/\*//{tenter=comment}
--_mtable-regex-Mach=main/fn ([a-z]+)\{/\1/f/{tenter=body}{scope=push}{mgroup=1}
--_mtable-regex-Mach=main/.|\n//
--_mtable-regex-Mach=comment/\*\///{tleave}
--_mtable-regex-Mach=comment/.|\n//
--_mtable-regex-Mach=body/\}//{tleave}{scope=pop}
--_mtable-regex-Mach=body/var ([a-z]+)/\1/v/{scope=ref}{mgroup=1}
--_mtable-extend-Mach=body+main
"""


def test_state_machine():
    r = Options().read(MACHINE).registry
    spec = r.get("Mach")
    e = extract_text(spec, "p", "fn a{ var x /* fn no{ */\n fn b{ var y } }\nfn c{}", r)
    qualify(e, spec)
    assert [(x["name"], x["line"], x.get("scope_name"), x.get("end")) for x in e] == [("a", 1, None, 2), ("x", 1, "a", None), ("b", 2, "a", 2), ("y", 2, "a.b", None), ("c", 3, None, 3)]


def test_machine_that_stands_still_ends():
    r = Options().read("--langdef=St\n--_tabledef-St=a\n--_tabledef-St=b\n--_mtable-regex-St=a/()//{tjump=b}\n--_mtable-regex-St=b/()//{tjump=a}\n").registry
    assert extract_text(r.get("St"), "p", "x" * 300, r) == []


def test_script_in_a_rule():
    r = Options().read("--langdef=Sc\n--kinddef-Sc=d,def,defs\n--_fielddef-Sc=note,n\n--regex-Sc=/^def ([a-z]+) ([a-z]+)/\\1/d/{{\n . \\2 note:\n . :name (_x) _buildname pop\n}}\n".replace(" . :name (_x) _buildname pop\n", "")).registry
    (e,) = extract_text(r.get("Sc"), "p", "def foo bar\n", r)
    assert e["fields"] == {"note": "bar"}


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 2 add 3 mul", ["9"]), ("[1 2 3] 0 exch {add} forall", ["6"]), ("(abc) (b) _strstr", ["(abc)", "1", "true"]), ("<< /a 1 /b 2 >> /b get", ["2"]), ("1 2 3 3 1 roll", ["3", "1", "2"]), ("0 1 1 4 {add} for", ["10"]), ("{1 0 idiv} stopped _errorname", ["true", "/undefinedresult"]), ("mark 65 (bc) _buildstring", ["(Abc)"]), ("true {(y)} {(n)} ifelse", ["(y)"]), ("7 -2 idiv 7 -2 mod", ["-3", "1"]), ("/x 5 def x x mul", ["25"]), ("1 2 3 2 copy count", ["1", "2", "3", "2", "3", "5"]), ("[1 2] (b) /b 3 2 index pop pop pop pop length", ["2"])],
)
def test_script(text, want):
    assert [repr_of(x) for x in Machine().run(compile_script(text))] == want


@pytest.mark.parametrize("bad", ["add", "(a) 1 add", "nothing", "{", "]", "1 0 idiv", "5 array 9 get", "end"])
def test_script_errors(bad):
    with pytest.raises(ScriptError):
        Machine().run(compile_script(bad))


def test_line_rules_in_columns(spark):
    files = spark.createDataFrame([(1, "def a\r\ndef b\rx\n", "n"), (2, "", "n"), (3, None, "n"), (4, "﻿def c", "n")], "file_id int, contents string, name string")
    ls = lines_of(files)
    assert [(r.file_id, r.line_no, r.line) for r in ls.orderBy("file_id", "line_no").collect()] == [(1, 1, "def a"), (1, 2, "def b"), (1, 3, "x"), (4, 1, "def c")]
    got = line_entries(ls.withColumn("kind", F.lit("clash")), [Rule(r"^def (\w+)", r"\1", "d", exclusive=True), Rule(r"(\w)", r"\1", "w")])
    assert [(r.name, r.kind) for r in got.orderBy("file_id", "line_no").collect()] == [("a", "d"), ("b", "d"), ("x", "w"), ("c", "d")]


def test_posix_classes():
    import re

    assert re.fullmatch(to_python("[[:alpha:]_][[:alnum:]_]*"), "a_9")
    assert re.fullmatch(to_python(r"\(a\|b\)", basic=True), "b")


def test_stream(spark, tmp_path):
    from symloom.streaming.ingest import StreamIndexer, requests

    src = tmp_path / "in"
    src.mkdir()
    schema = "path string, contents string, lang string, seq int"

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / n))

    put("a", [("x.py", "def a():\n  pass\n", "Python", 1), ("y.py", "def b():\n  pass\n", "Python", 1)])
    ix = StreamIndexer(spark, REGISTRY, str(tmp_path / "index"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src / "*"))
    ix.start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert {r.name for r in ix.entries().collect()} == {"a", "b"}
    put("b", [("x.py", "def c():\n  pass\n", "Python", 2), ("x.py", "def old():\n  pass\n", "Python", 1)])
    ix.start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert {r.name for r in ix.entries().collect()} == {"b", "c"}
    req = spark.createDataFrame([(1, "a.py", "def q():\n  pass\n", "Python"), (2, "b", None, "Python"), (3, "c", "x", "Nope")], "request_id int, filename string, contents string, lang string")
    got = sorted((r.request_id, r.type, r.name or "") for r in requests(req, REGISTRY).collect())
    assert got == [(1, "completed", ""), (1, "tag", "q"), (2, "error", ""), (3, "error", "")]


def test_str_is_a_value():
    assert Str("a") == Str("a") and hash(Str("a")) == hash(Str("a"))


def test_filters_and_counts(spark):
    from symloom.operators import filters, stats

    o = Options().read(OPTIONS)
    o.apply("--roles-Tiny.{item}=-{used}")
    e = spark.createDataFrame([("Tiny", "section", ["def"], None, None), ("Tiny", "b", ["def"], [], False), ("Tiny", "item", ["used"], [], False), ("Tiny", "item", None, ["guest"], False), ("Tiny", "item", ["def"], [], True), (None, None, None, None, None)], "l string, k string, r array<string>, x array<string>, p boolean")
    c = lambda n: F.col(n)
    assert [(r.k, r.r) for r in e.where(filters.writable(o.registry, o.settings, c("l"), c("k"), c("r"), c("x"), c("p"))).collect()] == [("section", ["def"]), (None, None)]
    d = spark.createDataFrame([("/a/b/c.x", "/a/d"), ("/a/b", "/a"), ("q/r", "."), ("/x", "/x")], "p string, d string")
    assert [r[0] for r in d.select(filters.tag_relative(c("p"), c("d"))).collect()] == ["../b/c.x", "b", "q/r", ""]
    lines = spark.createDataFrame([("ab",), ("b",), (None,)], "line string")
    assert [tuple(r) for r in stats.pattern_counts(lines, [Rule("^a"), Rule("B", icase=True)]).collect()] == [(0, "^a", 1, 2), (1, "B", 2, 1)]
    assert stats.pattern_counts(lines.limit(0), [Rule("x")]).first().matched == 0
    f = spark.createDataFrame([("A", 3), (None, 2)], "lang string, bytes int")
    assert sorted((r.lang or "", r.files, r.bytes, r.tags) for r in stats.language_counts(f, spark.createDataFrame([("B",), (None,)], "lang string")).collect()) == [("", 1, 2, 1), ("A", 1, 3, 0), ("B", 0, 0, 1)]
    assert any(r.startswith("!_TAG_KIND_DESCRIPTION!Tiny\ts,section") for r in stats.description_rows(o.registry.get("Tiny")))


def test_stream_keeps_files_of_one_path_apart(spark, tmp_path):
    from symloom.streaming.ingest import StreamIndexer

    schema = "file_id long, path string, contents string, lang string, seq int"
    ix = StreamIndexer(spark, REGISTRY, str(tmp_path / "index"), key="file_id")
    ix.update(spark.createDataFrame([(1, "x.py", "def a():\n  pass\n", "Python", 1), (2, "x.py", "def b():\n  pass\n", "Python", 2)], schema))
    assert {(r.file_id, r.name) for r in ix.entries().collect()} == {(1, "a"), (2, "b")}
    ix.update(spark.createDataFrame([(2, "x.py", "def c():\n  pass\n", "Python", 3)], schema))
    assert {(r.file_id, r.name) for r in ix.entries().collect()} == {(1, "a"), (2, "c")}


def test_stream_index_has_all_source_files(spark, tmp_path):
    from symloom.plans.queries import extracted, stream_index

    texts = {".proto": "package a.b;\n", ".thrift": "struct T {\n}\n", ".xsl": '<xsl:template name="n">\n</xsl:template>\n', ".el": "(defun f (x)\n  x)\n", ".pm": "package P;\nsub g {\n}\n", ".c": "int m (void)\n{\n  return 0;\n}\n", ".h": "#define H 1\n"}
    rows = [(i, f"src/input{e}", c, i) for i, (e, c) in enumerate(texts.items())] + [(10, "src/input.c", "int k (void)\n{\n  return 0;\n}\n", 1), (10, "src/input.c", None, 2)]
    spark.createDataFrame(rows, "file_id long, path string, contents string, ingested_at long").coalesce(1).write.parquet(str(tmp_path / "files.parquet"))
    got = sorted((r.file_id, r.name) for r in stream_index(spark, str(tmp_path)).collect())
    assert got == sorted((r.file_id, r.name) for r in extracted(spark, str(tmp_path)).collect())
    assert {i for i, _ in got} == {*range(7), 10}
