"""Finding inputs and their languages: scans, exclusion, detection, path folding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names left out of recursive scans by default.
DEFAULT_EXCLUDES = (
    "EIFGEN SCCS RCS CVS .git .svn .hg .bzr .deps .libs *.o *.lo *.la *.a *.so *.obj *.pyc *.class *.exe *.dll *.lib *.bak *.swp *~ "
    "tags TAGS GTAGS GRTAGS GPATH cscope.out autom4te.cache *.min.js *.min.css node_modules"
).split()


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a Java expression for the whole name; ``*`` also matches slashes, as in fnmatch."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = j
        else:
            out.append(re.sub(r"([\\.^$|+(){}\[\]])", r"\\\1", c))
        i += 1
    return "\\A(?:" + "".join(out) + ")\\z"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def excluded(path: Column, patterns=DEFAULT_EXCLUDES, exceptions=()) -> Column:
    """Whether a pattern fits the base name or the whole path and no exception does."""

    def fits(ps) -> Column:
        if not ps:
            return F.lit(False)
        p = "|".join(glob_to_regex(x) for x in ps)
        return base_name(path).rlike(p) | path.rlike(p)

    return fits(tuple(patterns)) & ~fits(tuple(exceptions))


def scan(spark: SparkSession, root: str, maxdepth: int | None = None, excludes=DEFAULT_EXCLUDES, exceptions=(), glob: str | None = None) -> DataFrame:
    """``path, contents, mtime, n_bytes`` of the files below ``root``; depth counts directories."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root).select("path", "modificationTime", "length", "content")
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")).replace("/", "\\/") + "/", "")
    df = df.withColumn("rel", rel).where(~excluded(F.col("rel"), excludes, exceptions))
    if maxdepth is not None:
        df = df.where(F.size(F.split("rel", "/")) <= maxdepth)
    return df.select("path", decode(F.col("content")).alias("contents"), F.col("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"))


def decode(content: Column, charset: str = "UTF-8") -> Column:
    """Text of bytes without a byte order mark; bytes that are not in the charset are replaced."""
    return F.regexp_replace(F.decode(content, charset), "^﻿", "")


def detect_by_name(files: DataFrame, langmap: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``detected``: the language whose map fits the name; patterns come before extensions, then names in order.

    ``langmap(lang, spec, pattern_text)`` is a table of settings. Extensions are an equi-join; patterns, few
    by nature, are turned into one expression.
    """
    ext = F.when(base_name(F.col(path)).contains("."), F.element_at(F.split(base_name(F.col(path)), r"\."), -1))
    by_ext = langmap.where("spec = 'extension'").groupBy(F.col("pattern_text").alias("_ext")).agg(F.min("lang").alias("_by_ext"))
    pats = [(r[0], r[1]) for r in langmap.where("spec = 'pattern'").select("lang", "pattern_text").orderBy("lang", "pattern_text").collect()]  # settings, one row a pattern
    by_pat = F.lit(None).cast("string")
    for lang, p in reversed(pats):
        by_pat = F.when(base_name(F.col(path)).rlike(glob_to_regex(p)), F.lit(lang)).otherwise(by_pat)
    return files.withColumn("_ext", ext).join(by_ext, "_ext", "left").withColumn("detected", F.coalesce(by_pat, F.col("_by_ext"))).drop("_ext", "_by_ext")


def interpreter(contents: Column) -> Column:
    """The interpreter of a ``#!`` line, behind env and without its path and version."""
    first = F.substring_index(contents, "\n", 1)
    cmd = F.regexp_extract(first, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?([A-Za-z_+-]+)", 1)
    return F.nullif(cmd, F.lit(""))


def editor_mode(contents: Column) -> Column:
    """The language that an Emacs or Vim mode line names, at the begin or the end."""
    head = F.substring_index(contents, "\n", 2)
    tail = F.substring_index(contents, "\n", -6)
    emacs = F.regexp_extract(head, r"-\*-\s*(?:[^\n]*?\bmode:\s*)?([\w+-]+)\s*(?:;[^\n]*)?-\*-", 1)
    local = F.regexp_extract(tail, r"(?i)local variables:[\s\S]*?mode:\s*([\w+-]+)", 1)
    vim = F.regexp_extract(F.concat_ws("\n", head, tail), r"(?m)\b(?:vim?|ex):\s*(?:set?\s+)?[^\n]*?\b(?:filetype|ft|syntax)=(\w+)", 1)
    return F.coalesce(F.nullif(emacs, F.lit("")), F.nullif(local, F.lit("")), F.nullif(vim, F.lit("")))


def select_by_content(contents: Column, first: str, second: str, first_rule: str, second_rule: str) -> Column:
    """Of two languages the one whose construct comes first in the text; null if neither does."""
    a, b = F.regexp_instr(contents, F.lit(first_rule)), F.regexp_instr(contents, F.lit(second_rule))
    return F.when((a > 0) & ((b == 0) | (a <= b)), F.lit(first)).when(b > 0, F.lit(second))


# Constructs that tell languages apart which share an extension.
SELECTORS = {
    ("Perl", "Raku"): (r"(?m)^\s*(?:use\s+5|package\s|sub\s|use\s+strict|=head\d|my\s+[$@%(])", r"(?m)^\s*(?:use\s+v6|(?:my\s+|our\s+)?class\s|grammar\s|role\s|(?:multi\s+)?method\s|token\s|unit\s)"),
    ("C", "C++"): (r"(?m)^\s*(?:typedef\s+struct|struct\s+\w+\s+\w+\s*=)", r"(?m)^\s*(?:class\s|namespace\s|template\s*<|using\s|public:|private:)"),
    ("ObjectiveC", "MatLab"): (r"(?m)^\s*(?:#import|#include|@interface|@implementation)", r"(?m)^\s*(?:function\b|%|classdef\b)"),
    ("Prolog", "Perl"): (r"(?m)^\s*:-\s", r"(?m)^\s*(?:use\s|package\s|sub\s|#!)"),
    ("Verilog", "V"): (r"(?m)^\s*(?:module\s+\w+\s*[(;#]|`)", r"(?m)^\s*(?:fn\s|pub\s|import\s|module\s+\w+\s*$)"),
    ("R", "Asm"): (r"<-", r"(?m)^\s*\.(?:text|globl|section|macro)\b"),
    ("Fortran", "Forth"): (r"(?mi)^\s*(?:program|subroutine|function|module|end)\b", r"(?m)^\s*(?::\s+\S+|\\\s)"),
    ("REXX", "DosBatch"): (r"\A/\*", r"(?mi)^\s*(?:@?echo|rem|set)\b"),
    ("Lisp", "LEX"): (r"(?m)^\s*\((?:def|in-package)", r"(?m)^%(?:\{|%|option)"),
    ("DBusService", "SystemdUnit"): (r"(?m)^\[D-BUS Service\]", r"(?m)^\[(?:Unit|Service|Socket|Install)\]"),
    ("QemuHX", "Haxe"): (r"(?m)^(?:STEXI|SRST|HXCOMM)\b", r"(?m)^\s*(?:class|package|import|using)\b"),
}


def language_of(path: Column, contents: Column, registry, force: str | None = None) -> Column:
    """The language of a file: by a pattern of its name, by its extension, else by the interpreter of a ``#!``
    line or by an editor's mode line; null if nothing tells.

    Where languages share an extension, the constructs of :data:`SELECTORS` decide, and the first by name where
    they do not. ``force`` overrides all. The maps are settings: they become literals of the expression.
    """
    if force and force.lower() != "auto":
        return F.lit(registry.get(force).name if registry.get(force) else None).cast("string")
    base = base_name(path)
    by_name = F.lit(None).cast("string")
    named = [(s.name, "|".join(glob_to_regex(p) for p in s.patterns)) for s in registry.specs.values() if s.patterns]
    for name, p in reversed(named):
        by_name = F.when(base.rlike(p), F.lit(name)).otherwise(by_name)
    if named:  # hardly a name fits one of them: all are asked at once first
        by_name = F.when(base.rlike("|".join(p for _, p in named)), by_name)
    of: dict[str, list[str]] = {}
    for s in registry.specs.values():
        for e in s.extensions:
            of.setdefault(e, []).append(s.name)
    ext = F.when(base.contains("."), F.element_at(F.split(base, r"\."), -1))
    table = F.create_map(*[x for e, names in of.items() for x in (F.lit(e), F.lit(names[0]))]) if of else None
    by_ext = F.try_element_at(table, ext) if table is not None else F.lit(None).cast("string")
    shared: dict[tuple[str, str], list[str]] = {}
    for e, names in of.items():
        for pair in SELECTORS:
            if set(pair) <= set(names):
                shared.setdefault(pair, []).append(e)
    for pair, exts in shared.items():
        by_ext = F.when(ext.isin(exts), F.coalesce(select_by_content(contents, *pair, *SELECTORS[pair]), by_ext)).otherwise(by_ext)
    known = {a.lower(): s.name for s in registry.specs.values() for a in (s.name, *s.aliases)}
    alias = F.create_map(*[x for a, n in known.items() for x in (F.lit(a), F.lit(n))]) if known else None
    said = [F.try_element_at(alias, F.lower(c)) for c in (interpreter(contents), editor_mode(contents))] if alias is not None else []
    return F.coalesce(by_name, by_ext, *said)


def fold_path(path: Column) -> Column:
    """``.``, ``..`` and empty segments resolved; a path that climbs above its begin keeps the rest.

    Absolute paths stay absolute; nothing left is ``.``.
    """
    segs = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & path.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def canonical(path: Column, cwd: Column, absolute: bool = False) -> Column:
    """A path against the directory an index was made in; below that directory it becomes relative again."""
    full = F.when(path.startswith("/"), fold_path(path)).otherwise(fold_path(F.concat(cwd, F.lit("/"), path)))
    if absolute:
        return full
    root = F.concat(fold_path(cwd), F.lit("/"))
    return F.when(F.startswith(full, root), F.substr(full, F.length(root) + F.lit(1))).otherwise(full)


def djb2(text: Column) -> Column:
    """The 32-bit hash that anonymous names carry, over the bytes of a text."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(hexed) / 2).cast("int")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def anonymous_name(prefix: str, path: Column, counter: Column, kind_index: Column) -> Column:
    pad = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    return F.concat(F.lit(prefix), pad(djb2(path), 8), pad(counter, 2), pad(kind_index, 2))
