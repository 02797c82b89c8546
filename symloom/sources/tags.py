"""Reading an index: rows ``name TAB input TAB address [;" TAB fields]`` and header rows ``!_...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.dsl import Row, ascii_lower, filter_column, format_column, sort_entries
from symloom.functions.escape import unescape
from symloom.operators.writers import MODES

# An address: a line number, a pattern that ends at its first delimiter behind an even number of
# backslashes, or both; a pattern that is not closed reaches to the end of the line.
_PATTERN = r"(?:/(?:[^\\/]|\\.)*(?:/|$)|\?(?:[^\\?]|\\.)*(?:\?|$))"
_ADDRESS = rf"^[^\t]*\t[^\t]*\t((?:\d+;)?{_PATTERN}|\d+|[^\t]*)"
#: Columns of a parsed row; ``fields`` keeps every key, the first of several.
SCHEMA = "name string, input string, pattern string, line long, kind string, file boolean, fields map<string,string>"


def parse_rows(lines: DataFrame, column: str = "value", unescape_input: bool = True) -> DataFrame:
    """Rows of an index from its lines; header rows and lines without two tabs are left out.

    All in built-in expressions, so filters on the result reach below the Python-free plan.
    """
    v = F.col(column)
    rows = lines.where(~v.startswith("!_") & v.rlike(r"^[^\t]+\t[^\t]*\t"))
    parts = F.split(v, "\t", 3)
    address = F.regexp_extract(v, _ADDRESS, 1)
    after = F.substr(v, F.length(F.get(parts, F.lit(0))) + F.length(F.get(parts, F.lit(1))) + F.length(address) + F.lit(3))
    # What follows the address: ;" and the fields, separated by tabs.
    fields = F.filter(F.split(F.regexp_replace(after, r'^;"\t?', ""), "\t"), lambda x: x != "")
    rows = rows.select(
        *[F.col(f"`{c}`") for c in lines.columns if c != column],
        unescape(F.get(parts, F.lit(0))).alias("name"),
        (unescape(F.get(parts, F.lit(1))) if unescape_input else F.get(parts, F.lit(1))).alias("input"),
        address.alias("address"),
        F.when(after.startswith(';"'), fields).otherwise(F.array().cast("array<string>")).alias("parts"),
    )
    pairs = F.transform(
        "parts",
        lambda x: F.struct(
            F.when(F.contains(x, F.lit(":")), F.substring_index(x, ":", 1)).otherwise(F.lit("kind")).alias("key"),
            unescape(F.when(F.contains(x, F.lit(":")), F.substr(x, F.instr(x, ":") + F.lit(1))).otherwise(x)).alias("value"),
        ),
    )
    rows = rows.withColumn("pairs", pairs)
    # The first of several equal keys counts.
    keys = F.transform("pairs", lambda q: q.getField("key"))
    firsts = F.filter("pairs", lambda p, i: F.array_position(keys, p.getField("key")) == i + 1)
    rows = rows.withColumn("fields", F.map_from_entries(firsts)).drop("parts", "pairs")
    f = lambda k: F.try_element_at("fields", F.lit(k))
    number = F.regexp_extract("address", r"^(\d+)(?:;|$)", 1)
    return rows.select(
        *[c for c in rows.columns if c not in ("address", "fields", "name", "input")],
        "name",
        "input",
        F.when(F.col("address").rlike(r"^\d+$"), F.col("address")).otherwise(F.regexp_replace("address", r"^\d+;", "")).alias("pattern"),
        F.coalesce(f("line").try_cast("long"), F.nullif(number, F.lit("")).try_cast("long")).alias("line"),
        f("kind").alias("kind"),
        F.map_contains_key("fields", F.lit("file")).alias("file"),
        "fields",
    )


def parse_ptags(lines: DataFrame, column: str = "value") -> DataFrame:
    """``ptag_name, parser, value, remark`` of the header rows; the parser stands behind ``!`` in the name."""
    v = F.col(column)
    parts = F.split(v, "\t", 3)
    name = F.get(parts, F.lit(0))
    return lines.where(v.startswith("!_")).select(
        *[F.col(f"`{c}`") for c in lines.columns if c != column],
        F.substring_index(F.substr(name, F.lit(2)), "!", 1).alias("ptag_name"),
        F.nullif(F.when(F.contains(F.substr(name, F.lit(2)), F.lit("!")), F.substring_index(name, "!", -1)), F.lit("")).alias("parser"),
        unescape(F.get(parts, F.lit(1))).alias("setting"),
        unescape(F.regexp_replace(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), "^/|/$", "")).alias("remark"),
    )


class Index:
    """An index as a table: list, find, filter, sort and print its entries."""

    def __init__(self, entries: DataFrame, ptags: DataFrame | None = None) -> None:
        self.entries, self.ptags = entries, ptags

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """From a text index. The input column is unescaped only if the header says so."""
        lines = spark.read.text(path)
        header = parse_ptags(lines)
        said = {(r[0], r[1]) for r in header.where(F.col("ptag_name").isin("_TAG_OUTPUT_MODE", "_TAG_OUTPUT_FILESEP")).select("ptag_name", "setting").distinct().limit(8).collect()}
        slash = ("_TAG_OUTPUT_MODE", MODES[0]) in said and ("_TAG_OUTPUT_FILESEP", "slash") in said
        return cls(parse_rows(lines, unescape_input=slash), header)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """From the columnar form that :meth:`save` writes."""
        return cls(spark.read.parquet(path))

    def save(self, path: str) -> None:
        """Sorted by name in ranges, so that name lookups skip files and row groups by their statistics."""
        self.entries.repartitionByRange("name").sortWithinPartitions("name").write.parquet(path)

    def row(self) -> Row:
        have = set(self.entries.columns)
        return Row({k: k for k in ("name", "input", "pattern", "line", "kind", "file", "language", "scope", "typeref", "roles", "extras", "signature", "access", "inherits", "end", "nth") if k in have}, "fields" if "fields" in have else None)

    def find(self, name: str, prefix: bool = False, ignore_case: bool = False) -> DataFrame:
        """Entries whose name is, or begins with, ``name``; letter case by ASCII rules."""
        return self.entries.where(name_matches(F.col("name"), name, prefix, ignore_case))

    def query(self, where: str | None = None, sort: str | None = None, form: str | None = None, strict: bool = False) -> DataFrame:
        df = self.entries
        if where:
            df = df.where(filter_column(where, self.row(), strict))
        if sort:
            row = self.row()
            df = sort_entries(df, sort, {k: k for k in row.columns}, "fields" if row.fields is not None else None)
        return df.select(format_column(form, self.row(), strict).alias("text")) if form else df


def name_matches(column: Column, name: str, prefix: bool = False, ignore_case: bool = False) -> Column:
    if ignore_case:
        column, name = ascii_lower(column), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
    return column.startswith(name) if prefix else column == name
