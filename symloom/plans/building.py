"""Queries over whole builds, script programs and samples of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.build import Built, build
from symloom.operators.languages import REGISTRY
from symloom.operators.spec import Registry
from symloom.plans.queries import _LINES_SQL, pattern_sql, query, t
from symloom.plans.samples import LANGUAGES, SCRIPTS

#: A language of headings in documents; the documents are inputs named ``d/<id>.doc``.
_HEADS = [
    "--langdef=Heads", "--map-Heads=.doc", "--kinddef-Heads=v,version,versions", "--kinddef-Heads=h,heading,headings", "--kinddef-Heads=i,item,items",
    r"--regex-Heads=/^Version ([0-9.]+)/\1/v/", r"--regex-Heads=/^#+ (.*)$/\1/h/", r"--regex-Heads=/^- ([A-Z][A-Za-z]+)/\1/i/",
]
_FOUND = f"""SELECT doc_id, line_no, line, kind, letter, name, 'd/' || doc_id || '.doc' AS path FROM (
 SELECT doc_id, line_no, line, 'version' AS kind, 'v' AS letter, regexp_extract(line, '^Version ([0-9.]+)', 1) AS name FROM ({_LINES_SQL})
 UNION ALL SELECT doc_id, line_no, line, 'heading', 'h', trim(regexp_extract(line, '^#+ (.*)$', 1)) FROM ({_LINES_SQL})
 UNION ALL SELECT doc_id, line_no, line, 'item', 'i', regexp_extract(line, '^- ([A-Z][A-Za-z]+)', 1) FROM ({_LINES_SQL})) WHERE name <> ''"""
_TAB = "chr(9)"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.format_string("d/%d.doc", "doc_id").alias("path"), F.col("text").alias("contents"))


def heads(s: SparkSession, d: str, *options: str, **more) -> Built:
    return build(_docs(s, d), [*_HEADS, *options], Registry(), **more)


def _rows(name: str, sql: str, *options: str) -> None:
    """A query for the distinct index rows under some options."""
    query(f"SELECT DISTINCT {sql} AS line FROM ({_FOUND})", name)(lambda s, d: heads(s, d, *options).rows)


_NAME = f"name || {_TAB} || path || {_TAB}"
_rows("build_pattern", f"{_NAME} || {pattern_sql('line', 96)} || ';\"' || {_TAB} || letter", "--excmd=pattern")
_rows("build_number", f"{_NAME} || line_no || ';\"' || {_TAB} || letter", "--excmd=number")
_rows("build_combine", f"{_NAME} || line_no || ';' || {pattern_sql('line', 96)} || ';\"' || {_TAB} || letter", "--excmd=combine")
_rows("build_pattern_limit", f"{_NAME} || {pattern_sql('line', 20)} || ';\"' || {_TAB} || letter", "--excmd=pattern", "--pattern-length-limit=20")
_rows("build_fields", f"{_NAME} || line_no || ';\"' || {_TAB} || kind || {_TAB} || 'line:' || line_no || {_TAB} || 'language:Heads'", "--excmd=number", "--fields=+Knl-t")
_rows("build_no_fields", f"{_NAME} || line_no", "--excmd=number", "--fields=")
_rows("build_xref", "rpad(name, CAST(greatest(16, length(name)) AS INTEGER), ' ') || ' ' || rpad(kind, 16, ' ') || ' ' || lpad(CAST(line_no AS VARCHAR), CAST(greatest(4, length(CAST(line_no AS VARCHAR))) AS INTEGER), ' ') || ' ' || rpad(path, CAST(greatest(16, length(path)) AS INTEGER), ' ') || ' ' || " + pattern_sql("line", 96), "--output-format=xref")
_rows("build_json", "'{\"_type\":\"tag\",\"name\":' || to_json(name) || ',\"path\":\"' || path || '\",\"pattern\":\"' || line_no || '\",\"kind\":\"' || letter || '\"}'", "--output-format=json", "--excmd=number", "--fields=k")
_rows("build_whole_files", f"{_NAME} || line_no || ';\"' || {_TAB} || letter", "--excmd=number", "--extras=-F", "--kinds-Heads=+h")


@query(f"SELECT DISTINCT {_NAME} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND}) WHERE letter <> 'i'")
def build_kinds(s, d):
    """A kind switched off."""
    return heads(s, d, "--excmd=number", "--kinds-Heads=-i").rows


@query(f"SELECT DISTINCT name || {_TAB} || doc_id || {_TAB} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND})")
def build_forced(s, d):
    """Inputs whose names say nothing, all read as one language."""
    docs = _docs(s, d).withColumn("path", F.col("file_id").cast("string"))
    return build(docs, [*_HEADS, "--excmd=number", "--language-force=Heads"], Registry()).rows


@query(f"SELECT DISTINCT {_NAME} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND}) WHERE suffix(CAST(doc_id AS VARCHAR), '3')")
def build_languages(s, d):
    """Of two languages, told apart by the pattern of a name, one switched on; a mapped extension taken away again."""
    other = ["--langdef=Other", "--map-Other=.doc", "--map-Heads=-.doc", "--map-Heads=+(*3.doc)", "--languages=Heads"]
    return heads(s, d, "--excmd=number", *other).rows


@query(f"SELECT DISTINCT name || {_TAB} || '../' || path || {_TAB} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND})")
def build_tag_relative(s, d):
    """Paths as seen from the directory of the index."""
    return heads(s, d, "--excmd=number", "--tag-relative=yes", index_dir="out").rows


@query(f"SELECT DISTINCT {_NAME} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND}) WHERE NOT suffix(CAST(doc_id AS VARCHAR), '7')")
def build_exclude(s, d):
    """Inputs whose names fit a pattern left out."""
    return heads(s, d, "--excmd=number", "--exclude=*7.doc").rows


@query(f"SELECT DISTINCT {_NAME} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND}) UNION SELECT 'kept' || {_TAB} || 'x/' || doc_id || '.doc' || {_TAB} || '1' FROM documents")
def build_append(s, d):
    """An older index with rows of the same inputs, which give way, and of others, which stay."""
    docs = t(s, d, "documents").select("doc_id")
    old = docs.select(F.format_string("stale\td/%d.doc\t1", "doc_id").alias("line")).unionByName(docs.select(F.format_string("kept\tx/%d.doc\t1", "doc_id").alias("line")))
    return heads(s, d, "--excmd=number", "--append=yes", old=old).rows


@query(f"SELECT line, row_number() OVER (ORDER BY translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), line) AS rank FROM (SELECT DISTINCT {_NAME} || line_no || ';\"' || {_TAB} || letter AS line FROM ({_FOUND}))")
def build_sorted(s, d):
    """The order of the rows of an index sorted without regard to case."""
    from symloom.functions.dsl import ascii_upper
    from symloom.operators.rank import ranked

    return ranked(heads(s, d, "--excmd=number", "--sort=foldcase").rows, [ascii_upper(F.col("line")), F.col("line")])


@query(f"SELECT * FROM (SELECT count(*) AS files, CAST(sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END) AS BIGINT) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL) CROSS JOIN (SELECT count(*) AS tags FROM ({_FOUND}))")
def build_totals(s, d):
    """What was read and what came of it."""
    return heads(s, d, "--totals=yes").totals()


@query("SELECT * FROM (VALUES ('!_TAG_FILE_FORMAT' || chr(9) || '2' || chr(9) || '/extended format/'), ('!_TAG_FILE_SORTED' || chr(9) || '2' || chr(9) || '/0=unsorted, 1=sorted, 2=foldcase/'), ('!_TAG_OUTPUT_MODE' || chr(9) || 'escaped' || chr(9) || '/form of the rows/'), ('!_TAG_OUTPUT_FILESEP' || chr(9) || 'slash' || chr(9) || '/slash or backslash/'), ('!_TAG_PATTERN_LENGTH_LIMIT' || chr(9) || '50' || chr(9) || '/0 for no limit/'), ('!_TAG_KIND_DESCRIPTION!Heads' || chr(9) || 'v,version' || chr(9) || '/versions/'), ('!_TAG_KIND_DESCRIPTION!Heads' || chr(9) || 'h,heading' || chr(9) || '/headings/'), ('!_TAG_KIND_DESCRIPTION!Heads' || chr(9) || 'i,item' || chr(9) || '/items/')) v(line)")
def build_header(s, d):
    """The header rows of an index."""
    return heads(s, d, "--sort=foldcase", "--pattern-length-limit=50").header()


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_text(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) v({columns})"


def run_program(program: str) -> str:
    """The stack, and behind a bar the output, of a script program in the context that ``samples`` describes."""
    from symloom.functions.script import Context, Machine, Name, ScriptError, compile_script, repr_of
    from symloom.operators.extract import Host
    from symloom.operators.spec import Kind, LanguageSpec

    spec = LanguageSpec("Sample", (Kind("c", "class"), Kind("d", "d")), params=(("known", "value"),))
    host = Host(spec, "input", "def foo bar\n", None, ("qualified",))
    blank = {"roles": [], "extras": []}
    host.entries = [{"name": "outer", "kind": "c", "line": 1, "end": 9, "fields": {}} | blank, {"name": "foo", "kind": "d", "line": 3, "fields": {}} | blank]
    host.scopes = [1]
    m = Machine(Context(("def foo bar", "foo", "bar"), ((0, 11), (4, 7), (8, 11)), host.entries, 2, host, dict(spec.params), host.line_of))
    # What the last operator did to the state machine can be seen only from outside.
    *main, last = program.split(" ")
    watch = last if last in ("_acted", "_advanced") else ""
    try:
        m.run(compile_script(" ".join(main) if watch else program))
    except ScriptError as e:
        return f"error {e}"
    if watch:
        m.stack.append([Name(x, True) for x in host.table_action] if watch == "_acted" else host.advance_to)
    out = " ".join("".join(m.out).split())
    return (" ".join(repr_of(x) for x in m.stack) + (f" | {out}" if m.out else "")).strip()


@query(_values([(o, p, r) for o, p, r in SCRIPTS], "operator, program, result"))
def script_programs(s, d):
    """Programs of the script language, run in the tasks: an operator or more each."""
    from symloom.sources.parallel import ready

    ready(s)
    rows = s.createDataFrame([(o, p) for o, p, _ in SCRIPTS], "operator string, program string")

    def run(batches):
        for b in batches:
            yield b.assign(result=[run_program(p) for p in b["program"]])

    return rows.mapInPandas(run, "operator string, program string, result string")


@query(_values([(lang, kind, name, line) for lang, _, want in LANGUAGES for kind, name, line in want], "language, kind, name, line"))
def language_samples(s, d):
    """Entries of a small source in each language: those asked for, by kind, name and line."""
    from symloom.operators.extract import extract_entries

    rows = s.createDataFrame([(i, f"sample{i}", text, lang) for i, (lang, text, _) in enumerate(LANGUAGES)], "file_id long, path string, contents string, lang string")
    asked = s.createDataFrame([(i, k, n, ln) for i, (_, _, want) in enumerate(LANGUAGES) for k, n, ln in want], "file_id long, kind string, name string, line int")
    langs = s.createDataFrame([(i, lang) for i, (lang, _, _) in enumerate(LANGUAGES)], "file_id long, language string")
    found = extract_entries(rows, REGISTRY, references=True).select("file_id", "kind", "name", F.col("line").cast("int").alias("line")).distinct()
    return asked.join(found, ["file_id", "kind", "name", "line"]).join(langs, "file_id").select("language", "kind", "name", "line")
