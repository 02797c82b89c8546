"""The queries over the reference's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.dsl import Row, filter_column, format_column, order_columns
from symloom.functions.escape import escape_name, unescape
from symloom.operators import scope, stats, writers
from symloom.operators.catalog import Catalog
from symloom.operators.extract import extract_entries, line_entries, lines_of, multi_name_list
from symloom.operators.languages import REGISTRY
from symloom.operators.rank import latest, ranked
from symloom.operators.spec import Registry, Rule
from symloom.sources import files as sources
from symloom.sources.parallel import spread
from symloom.sources.tags import name_matches, parse_rows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        n = name or f.__name__
        _QUERIES[n] = f
        if sql:
            _SQL[n] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the query language ---------------------------------------------------------------------------

#: How the tables look as entries: variables to columns, and the columns a query returns.
ENTRY_ROW = {
    "name": "tag_name", "input": "path", "pattern": "tag_pattern", "line": "line_no", "kind": "kind", "language": "lang", "end": "end_line", "file": "file_scope",
    "scope-kind": "scope_kind", "scope-name": "scope_name", "typeref": "typeref", "signature": "signature",
}
VIEWS = {
    "entries": (ENTRY_ROW, None, ("file_id", "entry_id", "tag_name", "line_no")),
    "part": ({"name": "p_name", "kind": "p_type", "line": "p_size", "input": "p_brand"}, None, ("p_partkey", "p_name")),
    "orders": ({"name": "o_orderpriority", "kind": "o_orderstatus", "line": "o_orderkey", "end": "o_custkey"}, None, ("o_orderkey",)),
    "customer": ({"name": "c_name", "kind": "c_mktsegment", "line": "c_custkey", "end": "c_nationkey"}, None, ("c_custkey", "c_name")),
    "documents": ({"name": "title", "input": "url", "language": "lang", "line": "doc_id"}, None, ("doc_id",)),
}

#: name: view, expression, SQL condition
FILTERS: dict[str, tuple[str, str, str]] = {
    "dsl_filter_basic": ("entries", '(and (eq? $kind "function") (prefix? $name "s") (> $line 20))', "kind = 'function' AND starts_with(tag_name, 's') AND line_no > 20"),
    "dsl_and_or_not": ("entries", '(and (or (eq? $language "C") (eq? $language "Perl")) (not (eq? $kind "function")))', "(coalesce(lang, '') IN ('C', 'Perl')) AND kind IS DISTINCT FROM 'function'"),
    "dsl_if": ("entries", "(if $end (> (- $end $line) 5) (< $line 10))", "CASE WHEN end_line IS NOT NULL THEN (end_line - line_no) > 5 ELSE line_no < 10 END"),
    "dsl_cond": ("entries", '(cond ((eq? $kind "f") (> $line 30)) ((eq? $kind "message") #t) ($file (prefix? $name "a")))', "CASE WHEN kind = 'f' THEN line_no > 30 WHEN kind = 'message' THEN true WHEN file_scope THEN starts_with(tag_name, 'a') ELSE false END"),
    "dsl_begin": ("part", '(begin (prefix? $name "a") (> $line 25))', "p_size > 25"),
    "dsl_begin0": ("part", "(begin0 (> $line 25) #f)", "p_size > 25"),
    "dsl_eq_null": ("entries", "(eq? $scope-name $typeref)", "scope_name IS NOT DISTINCT FROM typeref"),
    "dsl_eq_types": ("entries", '(or (eq? $line "13") (eq? $line 13))', "line_no = 13"),
    "dsl_missing": ("entries", "(not $scope-kind)", "scope_kind IS NULL"),
    "dsl_cmp": ("orders", "(and (>= $line 100) (<= $line 5000) (< $end 700))", "o_orderkey BETWEEN 100 AND 5000 AND o_custkey < 700"),
    "dsl_add_sub": ("entries", "(and $line $end (> (+ $line 20) $end) (> (- $end $line) 3))", "line_no + 20 > end_line AND end_line - line_no > 3"),
    "dsl_prefix": ("part", '(prefix? $name "s")', "starts_with(p_name, 's')"),
    "dsl_suffix": ("entries", '(suffix? $input ".thrift")', "suffix(path, '.thrift')"),
    "dsl_substr": ("entries", '(substr? $name "Pattern")', "contains(tag_name, 'Pattern')"),
    "dsl_member": ("entries", '(member $kind (list "service" "struct" "macro"))', "kind IN ('service', 'struct', 'macro')"),
    "dsl_downcase": ("entries", '(eq? (downcase $language) "emacslisp")', "lang = 'EmacsLisp'"),
    "dsl_upcase": ("customer", '(prefix? (upcase $kind) "AUTO")', "starts_with(upper(c_mktsegment), 'AUTO')"),
    "dsl_tr": ("entries", '(substr? (tr $name "-_") "_list")', "contains(replace(tag_name, '-', '_'), '_list')"),
    "dsl_length": ("documents", "(> (length $name) 18)", "strlen(title) > 18"),
    "dsl_concat": ("entries", '(eq? (concat $scope-kind ":" $kind) "message:field")', "scope_kind || ':' || kind = 'message:field'"),
    "dsl_regexp_quote": ("entries", '((string->regexp (regexp-quote "()")) $signature)', "contains(signature, '()')"),
    "dsl_regex_match": ("entries", "(#/^[a-z]+_[a-z]+$/ $name)", "regexp_matches(tag_name, '^[a-z]+_[a-z]+$')"),
    "dsl_regex_icase": ("entries", "(#/^STRING/i $name)", "regexp_matches(lower(tag_name), '^string')"),
    "dsl_regex_group": ("entries", '(eq? (#/^([a-z]+)_/ $name 1 "none") "none")', "NOT regexp_matches(tag_name, '^[a-z]+_')"),
    "dsl_string_regexp": ("entries", '((string->regexp "LIST" :case-fold #t) $name)', "contains(lower(tag_name), 'list')"),
    "dsl_scope_split": ("entries", '(and (eq? $typeref-kind "typename") (prefix? $typeref-name "map"))', "starts_with(typeref, 'typename:map')"),
    "dsl_or_value": ("entries", "(> (or $end $line) 60)", "coalesce(end_line, line_no) > 60"),
    "dsl_null": ("part", "(and (null? (quote ())) (> $line 25))", "p_size > 25"),
}


def _filter(view: str, exp: str) -> Query:
    columns, fields, out = VIEWS[view]
    return lambda s, d: t(s, d, view).where(filter_column(exp, Row(columns, fields))).select(*out)


for _n, (_v, _e, _w) in FILTERS.items():
    query(f"SELECT {', '.join(VIEWS[_v][2])} FROM {_v} WHERE {_w}", _n)(_filter(_v, _e))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events")
def dsl_dollar_default(s, d):
    """A field that is no column: looked up in a map, with a default."""
    ev = t(s, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    from symloom.functions.dsl import Compiler
    from symloom.functions.sexpr import read

    v = Compiler(Row({"name": "event_type"}, "m")).value(read('($ "k" "none")'))
    return ev.select("event_id", v.col.alias("k"))


def _sorter(view: str, exp: str, tie: str, out: str) -> Query:
    def run(s, d):
        columns = VIEWS[view][0]
        orders = order_columns(exp, Row(columns))
        return ranked(t(s, d, view), [*orders, F.col(tie)]).select(out, "rank")

    return run


for _n, _v, _e, _tie, _o in (
    ("sort_keys", "customer", "(<> $name &name)", "c_custkey", "c_name"),
    ("sort_flip", "customer", "(*- (<> $line &line))", "c_custkey", "c_custkey DESC"),
    ("sort_or", "part", "(<or> (<> $line &line) (*- (<> $name &name)))", "p_partkey", "p_size, p_name DESC"),
    ("sort_rank_predicate", "part", '(<or> (<> (if (> $line 25) -1 1) (if (> &line 25) -1 1)) (<> $name &name))', "p_partkey", "CASE WHEN p_size > 25 THEN -1 ELSE 1 END, p_name"),
    ("sort_length", "customer", "(<or> (<> (length $kind) (length &kind)) (<> $kind &kind))", "c_custkey", "strlen(c_mktsegment), c_mktsegment"),
):
    _k = {"customer": "c_custkey", "part": "p_partkey"}[_v]
    query(f"SELECT {_k}, row_number() OVER (ORDER BY {_o}, {_tie}) AS rank FROM {_v}", _n)(_sorter(_v, _e, _tie, _k))


def _format(view: str, exp: str) -> Query:
    columns, fields, out = VIEWS[view]
    return lambda s, d: t(s, d, view).select(*out, format_column(exp, Row(columns, fields)).alias("text"))


query("SELECT c_custkey, c_name, c_name || ' (' || c_mktsegment || ') ' || CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END || chr(10) AS text FROM customer", "format_basic")(_format("customer", '(list $name " (" $kind ") " $line #t)'))
query(
    "SELECT file_id, entry_id, tag_name, line_no, CASE WHEN file_scope THEN 'static ' ELSE '' END || coalesce(typeref, '') || ' ' || tag_name || ' ' || coalesce(CAST(coalesce(end_line, line_no) AS VARCHAR), '') AS text FROM entries", "format_nested"
)(_format("entries", '(list (if $file "static " #f) $typeref (list " " $name) " " (or $end $line))'))

# --- the index: lookup, reading, writing ------------------------------------------------------------


def _find(sql: str, query_name: str, *how):
    query(f"SELECT file_id, entry_id, tag_name FROM entries WHERE {sql}", query_name)(lambda s, d: t(s, d, "entries").where(name_matches(F.col("tag_name"), *how)).select("file_id", "entry_id", "tag_name"))


_find("tag_name = 'yystep'", "find_exact", "yystep")
_find("starts_with(tag_name, 'scope')", "find_prefix", "scope", True)
_find("lower(tag_name) = 'asso_values'", "find_icase", "ASSO_Values", False, True)
_find("starts_with(lower(tag_name), 'list')", "find_prefix_icase", "LIST", True, True)


@query("SELECT repo_id, substr(ptag_name, 2) AS ptag_name, parser_name AS parser, coalesce(setting, '') AS setting, coalesce(remark, '') AS remark FROM ptags")
def ptag_scan(s, d):
    """The header rows of all indexes, written as lines and read again."""
    from symloom.functions.escape import escape
    from symloom.sources.tags import parse_ptags

    name = F.concat("ptag_name", F.coalesce(F.concat(F.lit("!"), "parser_name"), F.lit("")))
    line = F.concat(name, F.lit("\t"), escape(F.coalesce("setting", F.lit(""))), F.lit("\t/"), escape(F.coalesce("remark", F.lit(""))), F.lit("/"))
    return parse_ptags(t(s, d, "ptags").select("repo_id", line.alias("value")))

_ONE = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id, entry_id ORDER BY indexed_at DESC) AS rn FROM entries) WHERE rn = 1"


def current(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The entries as indexed last, with the columns that the query needs."""
    return latest(t(s, d, "entries"), columns=columns or None)


query(f"SELECT file_id, entry_id, tag_name, kind, line_no, end_line, indexed_at FROM ({_ONE})", "latest_entries")(lambda s, d: current(s, d, "tag_name", "kind", "line_no", "end_line", "indexed_at"))


def _columns() -> dict:
    return {
        "name": unescape(F.col("tag_name")), "input": F.col("path"), "pattern": F.col("tag_pattern"), "kind": F.col("kind"), "line": F.col("line_no"), "language": F.col("lang"),
        "scope": F.when(F.col("scope_name").isNotNull(), F.concat("scope_kind", F.lit(":"), "scope_name")), "typeref": F.col("typeref"), "file": F.col("file_scope"), "signature": F.col("signature"), "end": F.col("end_line"),
    }


_TAGS_SQL = """tag_name || chr(9) || path || chr(9) || tag_pattern || ';"' || chr(9) || kind
 || coalesce(chr(9) || 'line:' || line_no, '') || coalesce(chr(9) || 'language:' || lang, '') || coalesce(chr(9) || 'scope:' || scope_kind || ':' || scope_name, '')
 || coalesce(chr(9) || 'typeref:' || typeref, '') || CASE WHEN file_scope THEN chr(9) || 'file:' ELSE '' END || coalesce(chr(9) || 'signature:' || signature, '') || coalesce(chr(9) || 'end:' || end_line, '')"""


@query(f"SELECT file_id, entry_id, {_TAGS_SQL} AS line FROM ({_ONE}) WHERE tag_pattern IS NOT NULL AND path IS NOT NULL")
def writer_tags(s, d):
    e = current(s, d, "tag_name", "path", "tag_pattern", "kind", "line_no", "lang", "scope_name", "scope_kind", "typeref", "file_scope", "signature", "end_line").where("tag_pattern IS NOT NULL AND path IS NOT NULL")
    return e.select("file_id", "entry_id", writers.tags_line(_columns()).alias("line"))


@query(f"SELECT file_id, entry_id, replace(tag_name, '\\x20', ' ') AS name, path AS input, kind, line_no AS line, end_line AS end_line, coalesce(file_scope, false) AS file, signature FROM ({_ONE}) WHERE tag_pattern IS NOT NULL AND path IS NOT NULL")
def read_index(s, d):
    """The written rows parsed again."""
    rows = parse_rows(writer_tags(s, d), "line")
    f = lambda k: F.try_element_at("fields", F.lit(k))
    # A pattern that is a number stands for the line where the row has none.
    return rows.select("file_id", "entry_id", "name", "input", "kind", f("line").cast("long").alias("line"), f("end").cast("long").alias("end_line"), "file", f("signature").alias("signature"))


@query(f"SELECT file_id, entry_id, rpad(tag_name, CAST(greatest(16, length(tag_name)) AS INTEGER), ' ') || ' ' || rpad(kind, CAST(greatest(10, length(kind)) AS INTEGER), ' ') || ' ' || lpad(coalesce(CAST(line_no AS VARCHAR), ''), CAST(greatest(4, length(coalesce(CAST(line_no AS VARCHAR), ''))) AS INTEGER), ' ') || ' ' || path AS line FROM ({_ONE})")
def writer_xref(s, d):
    columns = {"N": F.col("tag_name"), "K": F.col("kind"), "n": F.col("line_no"), "F": F.col("path")}
    return current(s, d, "tag_name", "kind", "line_no", "path").select("file_id", "entry_id", writers.xref_line("%-16N %-10K %4n %F", columns).alias("line"))


@query(f"SELECT file_id, entry_id, '{{\"_type\":\"tag\",\"name\":' || to_json(tag_name) || ',\"kind\":' || to_json(kind) || coalesce(',\"line\":' || line_no, '') || coalesce(',\"end\":' || end_line, '') || '}}' AS line FROM ({_ONE})")
def writer_json(s, d):
    return current(s, d, "tag_name", "kind", "line_no", "end_line").select("file_id", "entry_id", writers.json_line({"name": F.col("tag_name"), "kind": F.col("kind"), "line": F.col("line_no"), "end": F.col("end_line")}).alias("line"))


@query(f"SELECT path, CAST(sum(strlen(tag_pattern) + strlen(tag_name) + strlen(CAST(line_no AS VARCHAR)) + 5) AS BIGINT) AS n_bytes, count(*) AS n_entries FROM ({_ONE}) WHERE line_no IS NOT NULL GROUP BY path")
def etags_bytes(s, d):
    e = current(s, d, "path", "tag_pattern", "tag_name", "line_no").where("line_no IS NOT NULL").select("path", F.col("tag_pattern").alias("line_text"), F.col("tag_name").alias("name"), F.col("line_no").alias("line"), F.lit(0).alias("offset"))
    return writers.etags(e, "path").withColumn("n_bytes", F.col("n_bytes").cast("long"))


_ESCAPED_SQL = "replace(replace(replace(replace(x, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"


@query(f"SELECT doc_id, CASE WHEN left(x, 1) IN ('!', ' ') THEN '\\x' || CASE left(x, 1) WHEN '!' THEN '21' ELSE '20' END || substr({_ESCAPED_SQL}, 2) ELSE {_ESCAPED_SQL} END AS escaped, x AS back FROM (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL)")
def escape_roundtrip(s, d):
    """Whole texts escaped as names, and what unescaping gives back."""
    doc = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", escape_name(F.col("text")).alias("escaped"))
    return doc.select("doc_id", "escaped", unescape(F.col("escaped")).alias("back"))


_LINES_SQL = "SELECT doc_id, CAST(i AS BIGINT) AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''))"
query(_LINES_SQL, "scan_lines")(lambda s, d: lines_of(t(s, d, "documents"), "text", "doc_id"))


def pattern_sql(line: str, limit: int) -> str:
    """The search pattern of a line in SQL; a long line is cut behind the character that holds its last byte allowed."""
    long = f"octet_length(encode({line})) > {limit}"
    kept = f"CASE WHEN {long} THEN left({line}, list_filter(range(1, {limit} + 1), lambda k: octet_length(encode(left({line}, CAST(k AS INTEGER)))) >= {limit})[1]) ELSE {line} END"
    body = f"replace(replace({kept}, '\\', '\\\\'), '/', '\\/')"
    return f"'/^' || regexp_replace({body}, '\\$$', '\\\\$') || CASE WHEN {long} THEN '' ELSE '$' END || '/'"


@query(f"SELECT doc_id, line_no, {pattern_sql('line', 96)} AS pattern FROM ({_LINES_SQL})")
def pattern_column(s, d):
    """The search pattern of every line, long ones cut at a character border."""
    return lines_of(t(s, d, "documents"), "text", "doc_id").select("doc_id", "line_no", writers.pattern_of(F.col("line")).alias("pattern"))


@query(f"SELECT DISTINCT line FROM ({_LINES_SQL})")
def sort_dedupe_lines(s, d):
    return writers.sort_lines(lines_of(t(s, d, "documents"), "text", "doc_id"), "line")


_UPPER_SQL = "translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"SELECT line, row_number() OVER (ORDER BY {_UPPER_SQL}, line) AS rank FROM (SELECT DISTINCT line FROM ({_LINES_SQL}))")
def sort_foldcase(s, d):
    """All distinct lines by their upper-case form; only ASCII letters fold."""
    from symloom.functions.dsl import ascii_upper

    return ranked(lines_of(t(s, d, "documents"), "text", "doc_id").select("line").distinct(), [ascii_upper(F.col("line")), F.col("line")])


@query(f"SELECT doc_id, line_no, trim(regexp_replace(line, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS compact FROM ({_LINES_SQL})")
def compact_line(s, d):
    """All lines with runs of ASCII white space as one blank; other blanks stay."""
    return lines_of(t(s, d, "documents"), "text", "doc_id").select("doc_id", "line_no", writers.compact(F.col("line")).alias("compact"))


# --- extraction ---------------------------------------------------------------------------------------

_HEADS = [Rule(r"^Version ([0-9.]+)", r"\1", "version"), Rule(r"^#+ (.*)$", r"\1", "heading"), Rule(r"^- ([A-Z]\w+)", r"\1", "item")]


@query(f"SELECT doc_id, line_no, kind, name FROM (SELECT doc_id, line_no, 'version' AS kind, regexp_extract(line, '^Version ([0-9.]+)', 1) AS name FROM ({_LINES_SQL}) UNION ALL SELECT doc_id, line_no, 'heading', trim(regexp_extract(line, '^#+ (.*)$', 1)) FROM ({_LINES_SQL}) UNION ALL SELECT doc_id, line_no, 'item', regexp_extract(line, '^- ([A-Z]\\w+)', 1) FROM ({_LINES_SQL})) WHERE name <> ''")
def regex_line_extract(s, d):
    return line_entries(lines_of(t(s, d, "documents"), "text", "doc_id"), _HEADS).select("doc_id", "line_no", "kind", "name")


@query(f"SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^#+ .') THEN 'heading' ELSE 'word' END AS kind, CASE WHEN regexp_matches(line, '^#+ .') THEN trim(regexp_extract(line, '^#+ (.*)$', 1)) ELSE regexp_extract(line, '([a-z]+)', 1) END AS name FROM ({_LINES_SQL}) WHERE regexp_matches(line, '[a-z]|^#+ .') AND NOT (NOT regexp_matches(line, '^#+ .') AND regexp_extract(line, '([a-z]+)', 1) = '')")
def regex_exclusive(s, d):
    rules = [Rule(r"^#+ (.+)$", r"\1", "heading", exclusive=True), Rule(r"([a-z]+)", r"\1", "word")]
    return line_entries(lines_of(t(s, d, "documents"), "text", "doc_id"), rules).select("doc_id", "line_no", "kind", "name")


_GOOD = "(SELECT DISTINCT ON (file_id) file_id, path, contents, lang FROM files WHERE contents IS NOT NULL ORDER BY file_id)"


def good(s: SparkSession, d: str, *ext: str, **made: Column) -> DataFrame:
    """One row a readable file: ``file_id`` and the columns ``made`` of its path and contents.

    They are computed before the rows of repeated reads meet, so texts are not shuffled.
    """
    f = t(s, d, "files").where("contents IS NOT NULL")
    if ext:
        cond = F.lit(False)
        for e in ext:
            cond = cond | F.col("path").endswith(e)
        f = f.where(cond)
    f = f.select("file_id", "ingested_at", *[c.alias(k) for k, c in made.items()])
    return f.groupBy("file_id").agg(F.min_by(F.struct(*made), "ingested_at").alias("x")).select("file_id", *[f"x.{k}" for k in made])


@query(f"SELECT file_id, unnest(regexp_extract_all(contents, '<xsl:template name=\"([a-z_-]+)\"', 1)) AS name, 'n' AS kind FROM {_GOOD} WHERE suffix(path, '.xsl')")
def regex_multiline_extract(s, d):
    names = good(s, d, ".xsl", names=multi_name_list(F.col("contents"), Rule('<xsl:template name="([a-z_-]+)"', r"\1", "n")))
    return names.select("file_id", F.explode("names").alias("name"), F.lit("n").alias("kind"))


#: The languages of the source files; others are not asked for, which keeps the expression small.
_SOURCES = Registry({n: REGISTRY.specs[n] for n in ("Protobuf", "Thrift", "XSLT", "EmacsLisp", "Perl", "Raku", "C")})


def _lang(*ext: str) -> Column:
    """The language of a source file by its name and contents; null for endings other than ``ext``, if given."""
    found = sources.language_of(F.col("path"), F.col("contents"), _SOURCES)
    if not ext:
        return found
    return F.when(reduce(Column.__or__, [F.col("path").endswith(e) for e in ext]), found)


def extracted(s: SparkSession, d: str, *ext: str) -> DataFrame:
    """Entries of every readable row; rows of repeated reads are made one afterwards, so no text is shuffled."""
    f = t(s, d, "files").where("contents IS NOT NULL").select("file_id", "path", "contents", _lang(*ext).alias("lang")).where("lang IS NOT NULL")
    return extract_entries(spread(f), REGISTRY).dropDuplicates(["file_id", "entry_id"])


@query()
def extract_all(s, d):
    """All entries of all source files by the built-in rules of their languages."""
    return extracted(s, d).select("file_id", "entry_id", "language", "name", "kind", "line", "end", "scope_name")


query(f"SELECT file_id, name, kind FROM (SELECT file_id, unnest(regexp_extract_all(contents, '(?m)^package ([a-z.]+);', 1)) AS name, 'package' AS kind FROM {_GOOD} WHERE suffix(path, '.proto'))", "extract_proto_packages")(lambda s, d: extracted(s, d, ".proto").where("kind = 'package'").select("file_id", "name", "kind"))
query(f"SELECT file_id, name FROM (SELECT file_id, unnest(regexp_extract_all(contents, '<xsl:param name=\"([a-z_]+)\"', 1)) AS name FROM {_GOOD} WHERE suffix(path, '.xsl'))", "extract_xslt_params")(lambda s, d: extracted(s, d, ".xsl").where("kind = 'parameter'").select("file_id", "name"))


@query()
def tags_file(s, d):
    """The whole way: sources to sorted, distinct index lines."""
    e = extracted(s, d)
    columns = {"name": F.col("name"), "input": F.col("path"), "pattern": F.col("pattern"), "kind": F.col("kind_letter"), "scope": F.when(F.col("scope_name").isNotNull(), F.concat("scope_kind", F.lit(":"), "scope_name")), "typeref": F.col("typeref"), "file": F.col("file_scope")}
    return writers.sort_lines(e.select(writers.tags_line(columns).alias("line")), "line")


# --- relations between entries --------------------------------------------------------------------------


def _tree(s, d) -> DataFrame:
    """region, nation and customer as one file of nested entries."""
    r = t(s, d, "region").select(F.lit(1).alias("file_id"), F.col("r_regionkey").cast("long").alias("entry_id"), F.lit(None).cast("long").alias("scope_id"), F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    n = t(s, d, "nation").select(F.lit(1), (F.col("n_nationkey") + 1000).cast("long"), F.col("n_regionkey").cast("long"), "n_name", F.lit("nation"))
    c = t(s, d, "customer").select(F.lit(1), (F.col("c_custkey") + 1_000_000).cast("long"), (F.col("c_nationkey") + 1000).cast("long"), "c_name", F.lit("customer"))
    return r.unionAll(n).unionAll(c)


_TREE_SQL = """SELECT CAST(c_custkey + 1000000 AS BIGINT) AS entry_id, c_name AS name, r_name || '.' || n_name || '.' || c_name AS fqn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), n_name, r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, r_name FROM region"""
query(_TREE_SQL, "scope_fqn")(lambda s, d: scope.qualified_names(_tree(s, d), depth=4).select("entry_id", "name", "fqn"))
query(f"SELECT entry_id, name FROM ({_TREE_SQL}) UNION ALL SELECT entry_id, fqn FROM ({_TREE_SQL}) WHERE fqn <> name", "qualified_rows")(lambda s, d: scope.qualified_rows(scope.qualified_names(_tree(s, d), depth=4)).select("entry_id", "name"))
query(f"SELECT file_id, entry_id, row_number() OVER (PARTITION BY file_id, scope_name ORDER BY entry_id) - 1 AS nth FROM ({_ONE})", "nth_in_scope")(lambda s, d: scope.with_nth(current(s, d, "scope_name"), scope="scope_name").select("file_id", "entry_id", F.col("nth").cast("long").alias("nth")))
query(f"SELECT file_id, scope_name, count(*) AS n FROM ({_ONE}) WHERE scope_name IS NOT NULL GROUP BY ALL", "scope_children_count")(lambda s, d: scope.count_in_scope(current(s, d, "scope_name")))
query(
    f"SELECT p.file_id, p.entry_id, arg_max(e.entry_id, (e.line_no, e.entry_id)) AS enclosing_id FROM ({_ONE}) p LEFT JOIN ({_ONE}) e ON p.file_id = e.file_id AND e.end_line > e.line_no AND p.line_no BETWEEN e.line_no AND e.end_line WHERE p.line_no IS NOT NULL GROUP BY ALL", "interval_enclosing"
)(lambda s, d: scope.enclosing(current(s, d, "line_no").where("line_no IS NOT NULL").select("file_id", "entry_id", "line_no"), current(s, d, "line_no", "end_line", "tag_name").select("file_id", "entry_id", F.col("line_no").alias("line"), F.col("end_line").alias("end"), F.col("tag_name").alias("name"))).select("file_id", F.col("entry_id"), "enclosing_id"))


@query("SELECT c_custkey AS ref_id, CAST(r_regionkey AS BIGINT) AS target_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def symbol_resolve_outward(s, d):
    """A region's name, looked up from the scope of each of its customers."""
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    refs = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    refs = refs.select(F.lit(1).alias("file_id"), F.col("c_custkey").alias("ref_id"), (F.col("n_nationkey") + 1000).cast("long").alias("scope_id"), F.col("r_name").alias("name"))
    return scope.resolve(_tree(s, d), refs, depth=4).select("ref_id", "target_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def symbol_lookup_last(s, d):
    ev = t(s, d, "events")
    keys = ev.select("user_id", "event_type").distinct()
    return scope.lookup_last(ev.select("user_id", "event_type", "event_id"), keys, ["user_id", "event_type"], "event_id")


_END = f"coalesce(end_line, greatest(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no, entry_id) - 1, line_no))"
query(f"SELECT file_id, entry_id, {_END} AS end_line FROM ({_ONE}) WHERE line_no IS NOT NULL", "end_inference")(
    lambda s, d: scope.with_inferred_end(current(s, d, "line_no", "end_line").where("line_no IS NOT NULL").select("file_id", "entry_id", F.col("line_no").alias("line"), F.col("end_line").alias("end"))).select("file_id", "entry_id", F.col("end").alias("end_line"))
)
query(f"SELECT file_id, entry_id, tag_name FROM ({_ONE}) WHERE list_contains(role_list, 'def')", "roles_filter")(lambda s, d: current(s, d, "role_list", "tag_name").where(F.array_contains(F.coalesce("role_list", F.array().cast("array<string>")), "def")).select("file_id", "entry_id", "tag_name"))
query(f"SELECT file_id, entry_id, tag_name FROM ({_ONE}) WHERE NOT coalesce(list_contains(extra_list, 'fileScope'), false)", "extras_filter")(lambda s, d: current(s, d, "extra_list", "tag_name").where(~F.coalesce(F.array_contains("extra_list", "fileScope"), F.lit(False))).select("file_id", "entry_id", "tag_name"))


@query(f"SELECT e.file_id, e.entry_id, coalesce(k.kind, e.kind) AS kind FROM ({_ONE}) e LEFT JOIN kinds k ON e.lang = k.lang AND e.kind = k.kind_letter")
def kind_names(s, d):
    """Kind letters as long names, by the table of kinds."""
    k = t(s, d, "kinds").select("lang", F.col("kind_letter").alias("kind"), F.col("kind").alias("long"))
    return current(s, d, "lang", "kind").join(k, ["lang", "kind"], "left").select("file_id", "entry_id", F.coalesce("long", "kind").alias("kind"))


query("SELECT lang, kind, count(*) AS n FROM (SELECT e.lang, coalesce(k.kind, e.kind) AS kind FROM (" + _ONE + ") e LEFT JOIN kinds k ON e.lang = k.lang AND e.kind = k.kind_letter) GROUP BY ALL", "tags_per_kind")(
    lambda s, d: current(s, d, "lang", "kind").join(t(s, d, "kinds").select("lang", F.col("kind_letter").alias("kind"), F.col("kind").alias("long")), ["lang", "kind"], "left").groupBy("lang", F.coalesce("long", "kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
)
query(
    f"SELECT * FROM (SELECT count(*) AS files, CAST(sum(len(string_split(contents, chr(10))) - CASE WHEN suffix(contents, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS lines, CAST(sum(strlen(contents)) AS BIGINT) AS bytes FROM {_GOOD}) CROSS JOIN (SELECT count(*) AS tags, max(strlen(tag_name)) AS longest_name FROM ({_ONE}))", "totals_stats"
)(lambda s, d: scope.totals(good(s, d, lines=scope.line_count(F.col("contents")), bytes=F.octet_length("contents")), current(s, d, "tag_name")).select("files", "lines", "bytes", "tags", F.col("longest_name").cast("long").alias("longest_name")))


@query(f"SELECT f.file_id, min(l.lang) AS detected FROM {_GOOD} f LEFT JOIN langmap l ON l.spec = 'extension' AND regexp_extract(f.path, '\\.([^./]*)$', 1) = l.pattern_text GROUP BY f.file_id")
def detect_language(s, d):
    return sources.detect_by_name(good(s, d, path=F.col("path")), t(s, d, "langmap")).select("file_id", "detected")


def _selector_sql(pair: tuple[str, str]) -> str:
    """Of two languages the one whose construct comes first, in SQL; null if neither does."""
    at = [f"CASE WHEN regexp_matches(contents, '{p}') THEN length(regexp_extract(contents, '(?s)^(.*?)' || '{p}', 1)) END" for p in (r.replace("'", "''") for r in sources.SELECTORS[pair])]
    return f"CASE WHEN {at[0]} IS NOT NULL AND ({at[1]} IS NULL OR {at[0]} <= {at[1]}) THEN '{pair[0]}' WHEN {at[1]} IS NOT NULL THEN '{pair[1]}' END"


@query(f"SELECT file_id, {', '.join(f'{_selector_sql(p)} AS s{i}' for i, p in enumerate(sources.SELECTORS))} FROM {_GOOD}")
def detect_by_content(s, d):
    """Every pair of languages that constructs tell apart, asked of every source file."""
    made = {f"s{i}": sources.select_by_content(F.col("contents"), *p, *sources.SELECTORS[p]) for i, p in enumerate(sources.SELECTORS)}
    return good(s, d, **made)


_BY_EXTENSION = {".proto": "Protobuf", ".thrift": "Thrift", ".xsl": "XSLT", ".el": "EmacsLisp", ".c": "C", ".h": "C"}


@query(f"SELECT file_id, CASE {' '.join(f"WHEN suffix(path, '{e}') THEN '{n}'" for e, n in _BY_EXTENSION.items())} WHEN suffix(path, '.pm') THEN coalesce({_selector_sql(('Perl', 'Raku'))}, 'Perl') END AS language FROM {_GOOD}")
def detect_pipeline(s, d):
    """The language of every source file by name patterns, extensions, constructs, interpreter and mode lines."""
    return good(s, d, language=sources.language_of(F.col("path"), F.col("contents"), REGISTRY))


@query(f"SELECT file_id, CASE WHEN starts_with(path, './') THEN path[3:] ELSE path END AS folded FROM {_GOOD}")
def canonicalize_path(s, d):
    return good(s, d, folded=sources.canonical(F.col("path"), F.lit("/srv/build")))


@query("SELECT p_partkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(p_name, '')]), lambda h, c: (h * 33 + c) % 4294967296) AS h FROM part")
def anon_hash(s, d):
    return t(s, d, "part").select("p_partkey", sources.djb2(F.col("p_name")).alias("h"))


@query("SELECT file_id, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM (SELECT file_id, row_number() OVER (PARTITION BY file_id, entry_id ORDER BY indexed_at) AS rn FROM entries) GROUP BY file_id HAVING replaced > 0")
def append_replaced(s, d):
    """How many rows of each file a re-index replaces."""
    e = t(s, d, "entries")
    return e.groupBy("file_id", "entry_id").agg((F.count(F.lit(1)) - 1).alias("x")).groupBy("file_id").agg(F.sum("x").alias("replaced")).where("replaced > 0")


@query(f"SELECT file_id, path AS name, 'F' AS kind, 1 AS line, CAST(len(string_split(contents, chr(10))) - CASE WHEN suffix(contents, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS end_line FROM {_GOOD}")
def file_entries(s, d):
    """One entry an input file, from its first to its last line."""
    f = good(s, d, name=F.col("path"), end_line=scope.line_count(F.col("contents")))
    return f.select("file_id", "name", F.lit("F").alias("kind"), F.lit(1).alias("line"), "end_line")


@query(f"SELECT file_id, entry_id, tag_name FROM ({_ONE}) WHERE lang IN ('C', 'Perl') AND NOT (lang = 'C' AND kind IN ('f', 'function', 'l', 'local', 'p', 'prototype', 'x', 'externvar', 'z', 'parameter', 'L', 'label', 'D', 'macroparam')) AND NOT (lang = 'Perl' AND kind IN ('d', 'subroutineDeclaration', 'M', 'module', 'h', 'heredoc')) AND NOT coalesce(list_contains(extra_list, 'fileScope'), false)")
def writable_entries(s, d):
    """Languages, kinds and extras switched as by options, in one predicate."""
    from symloom.operators import filters
    from symloom.sources.options import Options

    registry = Registry({n: REGISTRY.get(n) for n in ("C", "Perl")})
    st = Options(registry)
    for o in ("--languages=C,Perl", "--kinds-C=-f", "--extras=-F"):
        st.apply(o)
    e = current(s, d, "lang", "kind", "role_list", "extra_list", "tag_name")
    return e.where(filters.writable(st.registry, st.settings, F.col("lang"), F.col("kind"), F.col("role_list"), F.col("extra_list"))).select("file_id", "entry_id", "tag_name")


query(f"SELECT i AS rule, p AS pattern, CAST(sum(CASE WHEN regexp_matches(line, p) THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN regexp_matches(line, p) THEN 0 ELSE 1 END) AS BIGINT) AS unmatched FROM ({_LINES_SQL}), (VALUES (0, '^Version ([0-9.]+)'), (1, '^#+ (.*)$'), (2, '^- ([A-Z]\\w+)')) r(i, p) GROUP BY ALL", "pattern_counters")(
    lambda s, d: stats.pattern_counts(lines_of(t(s, d, "documents"), "text", "doc_id"), _HEADS)
)
query(f"SELECT coalesce(f.lang, e.lang) AS lang, coalesce(files, 0) AS files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(tags, 0) AS tags FROM (SELECT lang, count(*) AS files, sum(strlen(contents)) AS bytes FROM {_GOOD} GROUP BY lang) f FULL JOIN (SELECT lang, count(*) AS tags FROM ({_ONE}) GROUP BY lang) e ON f.lang IS NOT DISTINCT FROM e.lang", "language_counters")(
    lambda s, d: stats.language_counts(good(s, d, lang=F.col("lang"), bytes=F.octet_length("contents").cast("long")), current(s, d, "lang"))
)


@query(f"SELECT e.file_id, e.entry_id, l.line FROM ({_ONE}) e JOIN (SELECT file_id, CAST(i AS BIGINT) AS line_no, ls[i] AS line FROM (SELECT file_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT file_id, string_split(replace(ltrim(contents, chr(65279)), chr(13), ''), chr(10)) AS ls FROM {_GOOD}))) l ON e.file_id = l.file_id AND e.line_no = l.line_no")
def entry_source_line(s, d):
    """Each entry with its line of the source: the line numbers of a file go to its text as one list, so a text
    moves at most once, as a whole, and only the lines asked for come out of it."""
    e = current(s, d, "line_no").where("line_no IS NOT NULL").select("file_id", "entry_id", "line_no")
    parts = F.split(F.regexp_replace(F.regexp_replace("contents", "^\ufeff", ""), r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    asked = e.groupBy("file_id").agg(F.collect_set("line_no").alias("asked"))  # of one file
    lines = t(s, d, "files").where("contents IS NOT NULL AND contents <> ''").select("file_id", "contents").join(asked, "file_id").withColumn("parts", parts)
    picked = lines.select("file_id", F.explode(F.transform("asked", lambda n: F.struct(n.alias("line_no"), F.get(F.col("parts"), (n - 1).cast("int")).alias("line")))).alias("x")).select("file_id", "x.*").where("line IS NOT NULL")
    return e.join(picked.dropDuplicates(["file_id", "line_no"]), ["file_id", "line_no"]).select("file_id", "entry_id", "line")


#: A language defined by options: a state machine over change logs.
_CHANGELOG = r"""
--langdef=ChangeLog
--kinddef-ChangeLog=v,version,versions
--kinddef-ChangeLog=i,item,items
--_tabledef-ChangeLog=main
--_tabledef-ChangeLog=body
--_mtable-regex-ChangeLog=main/Version ([0-9.]+)\n/\1/v/{scope=set}{tenter=body}{mgroup=1}
--_mtable-regex-ChangeLog=main/[^\n]*\n?//
--_mtable-regex-ChangeLog=body/- ([^\n]+)\n?/\1/i/{scope=ref}{mgroup=1}
--_mtable-regex-ChangeLog=body/\n//
--_mtable-regex-ChangeLog=body/()//{tleave}
"""


@query(f"SELECT doc_id, kind, name FROM (SELECT doc_id, 'version' AS kind, regexp_extract(line, '^Version ([0-9.]+)$', 1) AS name FROM ({_LINES_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lower(trim(source)) = 'changelog')) WHERE name <> ''")
def option_language(s, d):
    """Versions of change logs, by a language that an option file defines."""
    from symloom.sources.options import Options

    registry = Options().read(_CHANGELOG).registry
    docs = t(s, d, "documents").where("lower(trim(source)) = 'changelog'").select(F.col("doc_id").alias("file_id"), F.col("url").alias("path"), F.col("text").alias("contents"), F.lit("ChangeLog").alias("lang"))
    return extract_entries(docs, registry).where("kind = 'version'").select(F.col("file_id").alias("doc_id"), "kind", "name")


@query()
def stream_index(s, d):
    """The source files as a stream, indexed batch by batch; the index at the end."""
    import uuid

    from symloom.storage import shared_dir
    from symloom.streaming.ingest import StreamIndexer

    at = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    schema = t(s, d, "files").schema
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/files.parquet*")
    files = stream.where("contents IS NOT NULL").select("file_id", "path", "contents", _lang().alias("lang"), F.col("ingested_at").alias("seq")).where("lang IS NOT NULL")
    indexer = StreamIndexer(s, REGISTRY, at + "/index", key="file_id")
    indexer.start(files, at + "/state").awaitTermination()
    return indexer.entries().select("file_id", "path", "name", "kind", "line")


@query()
def catalog_kinds(s, d):
    return Catalog(s, REGISTRY).kinds()


@query()
def catalog_maps(s, d):
    return Catalog(s, REGISTRY).maps()


@query()
def catalog_operators(s, d):
    return Catalog(s, REGISTRY).operators()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the index, filtered by the query language and printed by its formatter."""
    e = current(spark, sf_dir, *ENTRY_ROW.values())
    row = Row(ENTRY_ROW)
    return e.where(filter_column('(and (or (eq? $kind "function") (eq? $kind "f")) $line)', row)).select("file_id", "entry_id", format_column('(list $name " " $signature " " $input ":" $line)', row).alias("text"))


def queries() -> dict[str, Query]:
    from symloom.plans import building  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from symloom.plans import building  # noqa: F401

    return dict(_SQL)
