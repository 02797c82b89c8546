"""Index rows as text: escaped and plain rows, etags, cross reference and JSON; header rows; sort and append."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.dsl import ascii_upper
from symloom.functions.escape import escape, escape_name

#: Fixed value: the order of extension fields in a row.
FIELD_ORDER = ("kind", "line", "language", "scope", "typeref", "file", "inherits", "access", "implementation", "signature", "roles", "extras", "xpath", "end", "epoch", "nth")
#: The escaping form of a row and the older one. A header names its form in a word of the tool that reads it: an argument.
MODES = ("escaped", "plain")
#: Fixed value: bytes of a line that a search pattern keeps.
PATTERN_LIMIT = 96


def pattern_of(line: Column, limit: int = PATTERN_LIMIT, delimiter: str = "/") -> Column:
    """The search pattern of a source line: ``/^line$/``, special characters escaped.

    A line longer than ``limit`` bytes is cut at a character border up to three bytes later, and then
    has no ``$``. Null lines give null.
    """
    flat = F.regexp_replace(line, r"[\r\n]+$", "")
    if limit:
        cut, long = _cut(flat, limit), F.octet_length(flat) > limit
    else:
        cut, long = flat, F.lit(False)
    body = F.when(long, cut).otherwise(flat)
    body = F.regexp_replace(body, r"([\\" + re.escape(delimiter) + "])", r"\\$1")
    body = F.regexp_replace(body, r"\$$", r"\\\$")
    return F.concat(F.lit(delimiter + "^"), body, F.when(long, F.lit("")).otherwise(F.lit("$")), F.lit(delimiter))


def _cut(text: Column, limit: int) -> Column:
    """``text`` cut after ``limit`` bytes; a character that begins within them stays whole."""
    # Only the first ``limit`` characters can matter; their running byte lengths find the end.
    head = F.substring(text, 1, limit)
    plain = F.octet_length(head) == F.length(head)
    chars = F.split(head, "")
    sizes = F.transform(chars, lambda c: F.octet_length(c))
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1))), lambda i: F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0), lambda a, b: a + b) < limit))
    return F.when(plain, head).otherwise(F.array_join(F.slice(chars, 1, n), ""))


def tags_line(columns: Mapping[str, Column], extra: Sequence[tuple[str, Column]] = (), escaped: bool = True) -> Column:
    """One row: ``columns`` has name, input, pattern and any of ``FIELD_ORDER``; null fields are left out.

    ``kind`` stands without its key, ``file`` without a value; further parser fields come last.
    """
    e = escape if escaped else (lambda c: c)
    parts = []
    for k in FIELD_ORDER:
        if k in columns:
            c = columns[k]
            if k == "file":
                parts.append(F.when(c, F.lit("file:")))
            else:
                v = e(c.cast("string"))
                parts.append(v if k == "kind" else F.when(c.isNotNull(), F.concat(F.lit(k + ":"), v)))
    parts += [F.when(c.isNotNull(), F.concat(F.lit(k + ":"), e(c.cast("string")))) for k, c in extra]
    name = escape_name(columns["name"]) if escaped else columns["name"]
    base = F.concat_ws("\t", name, e(columns["input"]), columns["pattern"])
    fields = F.concat_ws("\t", *parts) if parts else F.lit("")
    return F.when(fields != "", F.concat(base, F.lit(';"\t'), fields)).otherwise(base)


def etags_writable(columns: Mapping[str, Column]) -> Column:
    """Rows of the older form cannot escape: a tab or line end in any field drops the row."""
    bad = [F.coalesce(c.cast("string").rlike(r"[\t\n\r]"), F.lit(False)) for k, c in columns.items() if k != "file"]
    out = F.lit(True)
    for b in bad:
        out = out & ~b
    return out


def etags(entries: DataFrame, path: str = "input", line_text: str = "line_text", name: str = "name", line: str = "line", offset: str = "offset") -> DataFrame:
    """``path, n_bytes, n_entries``: the sections of an etags file, with the byte count that heads each.

    Sizes combine on the map side; the rows of a section are :func:`etags_row`, so no section is gathered.
    """
    row = etags_row(F.col(line_text), F.col(name), F.col(line), F.col(offset))
    return entries.groupBy(path).agg(F.sum(F.octet_length(row) + 1).alias("n_bytes"), F.count(F.lit(1)).alias("n_entries"))


def etags_row(text: Column, name: Column, line: Column, offset: Column) -> Column:
    return F.concat(text, F.lit("\x7f"), name, F.lit("\x01"), line.cast("string"), F.lit(","), offset.cast("string"))


_XREF = re.compile(r"%(?:(%)|(-)?(\.)?(\d+)?(?:\{([^}]+)\}|([A-Za-z])))|([^%]+)")


def xref_line(form: str, columns: Mapping[str, Column]) -> Column:
    """``%[-][.][width](letter|{field})``: width pads on the left or right, ``.`` also truncates to it."""
    parts: list[Column] = []
    for m in _XREF.finditer(form):
        if m.group(7) is not None:
            parts.append(F.lit(m.group(7)))
            continue
        if m.group(1):
            parts.append(F.lit("%"))
            continue
        key = m.group(5) or m.group(6)
        v = F.coalesce(columns[key].cast("string"), F.lit(""))
        if m.group(4):
            n = int(m.group(4))
            width = F.lit(n) if m.group(3) else F.greatest(F.lit(n), F.length(v))
            v = F.rpad(v, width, " ") if m.group(2) else F.lpad(v, width, " ") if not m.group(3) else F.lpad(F.substring(v, 1, n), n, " ")
        parts.append(v)
    return F.concat(*parts)


#: Fixed value: the default form of a cross reference.
XREF_DEFAULT = "%-16N %-10K %4n %-16F %C"


def compact(line: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def json_line(columns: Mapping[str, Column]) -> Column:
    """One JSON object an entry; null fields are left out, types stay."""
    return F.to_json(F.struct(F.lit("tag").alias("_type"), *[c.alias(k) for k, c in columns.items()]))


def sort_lines(lines: DataFrame, column: str = "line", how: str = "yes") -> DataFrame:
    """Distinct lines in byte order; ``foldcase``: by the upper-case form first. ``no`` leaves them."""
    if how == "no":
        return lines
    d = lines.select(column).distinct()
    return d.orderBy(ascii_upper(F.col(column)), column) if how == "foldcase" else d.orderBy(column)


def append(old: DataFrame, new: DataFrame, path: str = "input") -> DataFrame:
    """The index with the rows of re-scanned inputs replaced."""
    return old.join(new.select(path).distinct(), path, "left_anti").unionByName(new, allowMissingColumns=True)


def header_rows(spark, sort: str = "yes", mode: str = MODES[0], limit: int = PATTERN_LIMIT) -> DataFrame:
    """Header rows of an index, as lines."""
    rows = [
        ("!_TAG_FILE_FORMAT", "2", "extended format"),
        ("!_TAG_FILE_SORTED", {"no": "0", "yes": "1", "foldcase": "2"}[sort], "0=unsorted, 1=sorted, 2=foldcase"),
        ("!_TAG_OUTPUT_MODE", mode, "form of the rows"),
        ("!_TAG_OUTPUT_FILESEP", "slash", "slash or backslash"),
        ("!_TAG_PATTERN_LENGTH_LIMIT", str(limit), "0 for no limit"),
    ]
    return spark.createDataFrame([(f"{a}\t{b}\t/{c}/",) for a, b, c in rows], "line string")
