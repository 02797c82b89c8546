"""Whole builds with options, detection, script programs and samples of languages."""

import pytest

from symloom.operators.build import build
from symloom.plans.building import run_program
from symloom.plans.samples import LANGUAGES, SCRIPTS
from symloom.sources.options import OptionError

FILES = [
    (1, "src/a.c", "#define M 1\nstatic int f (int a)\n{\n  return a;\n}\n"),
    (2, "lib/p.pm", "use v6;\nclass K {\n  method m() { }\n}\n"),
    (3, "run", "#!/usr/bin/env python3\nclass C:\n    def m(self):\n        pass\n"),
    (4, "x.c", None),
    (5, "./q/Makefile", "A = 1\nall: x\n"),
    (6, "none", ""),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, contents string")


def rows(files, *options, **more):
    return [r[0] for r in build(files, list(options), **more).rows.collect()]


def test_languages_and_addresses(files):
    assert rows(files) == [
        'A\t./q/Makefile\t1;"\tm', 'C\trun\t/^class C:$/;"\tc', 'K\tlib/p.pm\t/^class K {$/;"\tc', 'M\tsrc/a.c\t1;"\td', 'all\t./q/Makefile\t/^all: x$/;"\tt',
        'f\tsrc/a.c\t/^static int f (int a)$/;"\tf\ttyperef:typename:int\tfile:', 'm\tlib/p.pm\t/^  method m() { }$/;"\tm\tscope:class:K', 'm\trun\t/^    def m(self):$/;"\tm\tscope:class:C',
    ]
    assert rows(files, "--languages=C", "--kinds-C=-f", "--fields=", "--excmd=combine") == ["M\tsrc/a.c\t1;/^#define M 1$/"]
    assert rows(files, "--languages=C", "--fields=+K", "--pattern-length-limit=8", "--excmd=pattern")[1] == 'f\tsrc/a.c\t/^static i/;"\tfunction\ttyperef:typename:int\tfile:'
    assert [x.split("\t")[0] for x in rows(files, "--sort=foldcase", "--exclude=*.pm")] == ["A", "all", "C", "f", "m", "M"]


def test_further_rows(files):
    got = rows(files, "--languages=Python,Raku", "--extras=+qf", "--excmd=number", "--fields=")
    assert {"C.m\trun\t3", "K::m\tlib/p.pm\t3", "run\trun\t1", "p.pm\tlib/p.pm\t1"} <= set(got)
    assert rows(files, "--output-format=json", "--languages=Make", "--fields=k", "--excmd=number")[0] == '{"_type":"tag","name":"A","path":"./q/Makefile","pattern":"1","kind":"m"}'
    assert "int f (int a)\x7ff\x012,0" in "\n".join(rows(files, "--output-format=etags", "--languages=C"))


def test_append_totals_and_refusal(files, spark, tmp_path):
    old = spark.createDataFrame([("!_TAG_X\t1\t//",), ("gone\tsrc/a.c\t9",), ("kept\ty.c\t9",)], "line string")
    got = rows(files, "--languages=C", "--append=yes", "--excmd=number", "--fields=", old=old)
    assert got == ["M\tsrc/a.c\t1", "f\tsrc/a.c\t2", "kept\ty.c\t9"]
    assert tuple(build(files, []).totals().first()) == (5, 15, sum(len(c) for _, _, c in FILES if c), 8)
    assert build(files.limit(0), []).rows.count() == 0 and tuple(build(files.limit(0), []).totals().first()) == (0, 0, 0, 0)
    for bad in ("--nothing=1", "--excmd=odd", "--output-format=odd"):
        with pytest.raises(OptionError):
            rows(files, bad)
    build(files, ["--languages=C"]).write(str(tmp_path / "tags"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "tags")).collect()]
    assert lines[0].startswith("!_TAG_") and lines[-1].startswith("f\t")
    build(files, ["--languages=C"]).write(str(tmp_path / "tags"))
    (tmp_path / "precious").write_text("int main;\n")
    with pytest.raises(OptionError):
        build(files, []).write(str(tmp_path / "precious"))


@pytest.mark.parametrize(("operator", "program", "result"), SCRIPTS)
def test_script_programs(operator, program, result):
    assert run_program(program) == result


def test_every_operator_has_a_program():
    from symloom.functions.script import OPS

    assert set(OPS) - {"_help"} <= {o for o, _, _ in SCRIPTS}


@pytest.mark.parametrize(("lang", "text", "want"), LANGUAGES, ids=[x[0] for x in LANGUAGES])
def test_language_sample(lang, text, want):
    from symloom.operators.extract import extract_text
    from symloom.operators.languages import REGISTRY

    got = {(e["kind"], e["name"], e["line"]) for e in extract_text(REGISTRY.get(lang), "sample", text, REGISTRY)}
    assert set(want) <= got, got
