"""Building an index with options: inputs and switches to entries, index rows, header rows and totals.

The settings that :mod:`symloom.sources.options` reads are used here, but for those of the scan (encodings and
recursion belong to :func:`symloom.sources.files.scan`) and extras of single languages; ``totals`` is a method.
Options that nothing knows are refused.
Defined results: files with null contents or of no known language are counted as inputs and give no entries;
equal rows become one when the index is sorted; an empty table gives an index of header rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.operators import filters, writers
from symloom.operators.extract import extract_entries
from symloom.operators.languages import REGISTRY
from symloom.operators.scope import line_count
from symloom.operators.spec import Registry
from symloom.operators.stats import description_rows
from symloom.sources import files as sources
from symloom.sources.options import OptionError, Options

# Letters of the fields that a row may carry beside name, input and pattern, by the name of the field.
LETTERS = {
    "kind": "k", "line": "n", "language": "l", "scope": "s", "typeref": "t", "file": "f", "inherits": "i", "access": "a", "implementation": "m",
    "signature": "S", "roles": "r", "extras": "E", "xpath": "x", "end": "e", "epoch": "T", "nth": "o",
}
#: Formats of the rows: the escaped and the plain form, the editor's form, cross reference, JSON.
FORMATS = ("escaped", "plain", "etags", "xref", "json")


def format_of(name: str) -> str:
    """The format that an ``--output-format`` names; the forms of the index may be given by their first letter."""
    low = name.lower()
    got = low if low in FORMATS else {"u-": "escaped", "e-": "plain"}.get(low[:2])
    if got is None:
        raise OptionError(f"unknown output format: {name}")
    return got


@dataclass
class Built:
    """An index that was built: everything is lazy and comes from one extraction of the inputs."""

    inputs: DataFrame
    options: Options
    old: DataFrame | None = None
    index_dir: str = "."

    @property
    def _settings(self):
        return self.options.settings

    @cached_property
    def detected(self) -> DataFrame:
        """``file_id, path, contents, lang`` of the inputs that the switches leave."""
        st, registry = self._settings, self.options.registry
        df = self.inputs.where(~sources.excluded(F.col("path"), tuple(st.excludes)) if st.excludes else F.lit(True))
        if st.maxdepth is not None:
            df = df.where(F.size(F.split(sources.fold_path(F.col("path")), "/")) <= st.maxdepth)
        lang = sources.language_of(F.col("path"), F.col("contents"), registry, st.language_force)
        for new, old in st.pretend.items():  # a language that stands in for another
            lang = F.when(lang == F.lit(old), F.lit(new)).otherwise(lang)
        df = df.select("file_id", "path", "contents", lang.alias("lang"))
        return df.where(filters.languages_enabled(F.col("lang"), st)) if st.languages is not None else df

    @cached_property
    def entries(self) -> DataFrame:
        """Entries as the switches for kinds, roles and extras leave them, with whole-file and qualified ones if asked for."""
        st, registry = self._settings, self.options.registry
        e = extract_entries(self.detected, registry, references="r" in st.extras, limit=st.pattern_limit)
        e = e.where(filters.writable(registry, st, F.col("language"), F.col("kind"), F.col("roles"), F.col("extras"), F.col("placeholder")))
        if "q" in st.extras:
            dot = F.lit(".")
            for s in registry.specs.values():
                if s.default_separator != ".":
                    dot = F.when(F.col("language") == s.name, F.lit(s.default_separator)).otherwise(dot)
            more = e.where("scope_name IS NOT NULL").withColumn("name", F.concat("scope_name", dot, "name"))
            e = e.unionByName(more.withColumn("extras", F.array_union(F.coalesce("extras", F.array().cast("array<string>")), F.array(F.lit("qualified")))))
        if "f" in st.extras:
            whole = self.detected.where("contents IS NOT NULL").select(
                F.col("file_id").cast("long").alias("file_id"), "path", F.col("lang").alias("language"), sources.base_name(F.col("path")).alias("name"), F.lit("file").alias("kind"), F.lit("F").alias("kind_letter"),
                F.lit(1).cast("long").alias("line"), line_count(F.col("contents")).alias("end"), F.array(F.lit("inputFile")).alias("extras"), F.lit("1").alias("pattern"),
            )
            e = e.unionByName(whole, allowMissingColumns=True)
        return e

    def _on(self, field: str) -> bool:
        letter = LETTERS.get(field)
        return field in self._settings.fields or letter is not None and letter in self._settings.fields

    def _columns(self) -> dict[str, Column]:
        st = self._settings
        c = F.col
        path = filters.tag_relative(c("path"), F.lit(self.index_dir)) if st.tag_relative in ("yes", "always") else c("path")
        number = c("line").cast("string")
        # As a number, as a pattern, or a number where a pattern would not find the line.
        address = {"number": number, "pattern": c("pattern")}.get(st.excmd, F.when(c("kind_letter") == "F", number).when(F.lit(st.excmd in ("mix", "mixed")) & (c("kind") == "macro"), number).otherwise(c("pattern")))
        if st.excmd == "combine":
            address = F.when(c("kind_letter") == "F", number).otherwise(F.concat(number, F.lit(";"), c("pattern")))
        kind = c("kind") if "K" in st.fields or "{kind}" in st.fields else F.coalesce(c("kind_letter"), c("kind"))
        out = {"name": c("name"), "input": path, "pattern": address, "kind": kind, "line": c("line"), "language": c("language"), "typeref": c("typeref"), "file": c("file_scope"), "signature": c("signature"), "end": c("end"), "nth": c("nth"), "access": c("access"), "inherits": c("inherits")}
        out["scope"] = F.when(c("scope_name").isNotNull(), F.concat("scope_kind", F.lit(":"), "scope_name"))
        out["roles"] = F.array_join(F.coalesce("roles", F.array(F.lit("def"))), ",")
        out["extras"] = F.nullif(F.array_join(F.coalesce("extras", F.array().cast("array<string>")), ","), F.lit(""))
        return {k: v for k, v in out.items() if k in ("name", "input", "pattern") or self._on(k) or k == "kind" and "K" in st.fields}

    def _own_fields(self) -> list[tuple[str, Column]]:
        """Fields of the languages themselves; those switched off are left out."""
        names = {f for s in self.options.registry.specs.values() for f, _ in s.fields}
        off = {f for lang, on in self._settings.language_fields.items() for f, _ in self.options.registry.get(lang).fields if f not in on}
        return [(n, F.try_element_at("fields", F.lit(n))) for n in sorted(names - off)]

    @cached_property
    def rows(self) -> DataFrame:
        """``line``: the index rows without header, in the form and order that the options name."""
        st, e, cols = self._settings, self.entries, self._columns()
        form = format_of(st.output_format)
        if form == "json":
            fields = {"name": cols["name"], "path": cols["input"], "pattern": cols["pattern"], **{k: v for k, v in cols.items() if k not in ("name", "input", "pattern")}}
            made = e.select(writers.json_line(fields).alias("line"))
        elif form == "xref":
            made = e.select(writers.xref_line("%-16N %-16K %4n %-16F %P", {"N": cols["name"], "K": F.col("kind"), "n": F.col("line"), "F": cols["input"], "P": F.col("pattern")}).alias("line"))
        elif form == "etags":
            text = F.regexp_replace("pattern", r"^/\^|\$?/$", "")
            made = e.select(writers.etags_row(text, F.col("name"), F.col("line"), F.lit(0)).alias("line"))
        else:
            if form == "plain":
                e = e.where(writers.etags_writable({k: v for k, v in cols.items() if k not in ("line", "end", "nth")}))
            made = e.select(writers.tags_line(cols, self._own_fields(), form == "escaped").alias("line"))
        if st.append and self.old is not None:
            # Rows of inputs that were read again give way.
            read = self.detected.select(F.col("path").alias("_input")).distinct()
            kept = self.old.where(~F.col("line").startswith("!_")).withColumn("_input", F.get(F.split("line", "\t", 3), F.lit(1))).join(read, "_input", "left_anti").select("line")
            made = made.unionByName(kept)
        return writers.sort_lines(made, "line", st.sort)

    def header(self, mode: str = writers.MODES[0]) -> DataFrame:
        """``line``: the header rows; ``mode`` is the word by which readers know the form of the rows."""
        st, spark = self._settings, self.inputs.sparkSession
        h = writers.header_rows(spark, st.sort, mode, st.pattern_limit)
        seen = [r[0] for r in self.entries.select("language").distinct().collect()]  # one row a language
        own = [x for n in sorted(x for x in seen if x) if (s := self.options.registry.get(n)) for x in description_rows(s)]
        return h.unionByName(spark.createDataFrame([(x,) for x in own], "line string")) if own else h

    def totals(self) -> DataFrame:
        """``files, lines, bytes, tags``: what was read and what came of it."""
        read = self.detected.where("contents IS NOT NULL")
        f = read.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(line_count(F.col("contents"))), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.octet_length("contents")).cast("long"), F.lit(0)).alias("bytes"))
        return f.crossJoin(self.entries.agg(F.count(F.lit(1)).alias("tags")))  # one row with one row

    def write(self, path: str, mode: str = writers.MODES[0]) -> None:
        """The index as text below ``path``; a folder that holds anything but an index is not overwritten."""
        spark = self.inputs.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            first = spark.read.text(path).limit(1).collect()
            if first and not first[0][0].startswith("!_TAG") and "\t" not in first[0][0]:
                raise OptionError(f"{path} is not an index")
        # Ranges keep the order over the files of the folder; header rows sort before all names.
        everything = self.header(mode).select(F.lit(0).alias("k"), "line").unionByName(self.rows.select(F.lit(1).alias("k"), "line"))
        everything.orderBy("k", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def build(inputs: DataFrame, options: list[str] | str = (), registry: Registry | None = None, old: DataFrame | None = None, index_dir: str = ".") -> Built:
    """Builds an index of ``inputs(file_id, path, contents)``; ``options`` are option lines, in their order."""
    o = Options(Registry(dict((registry or REGISTRY).specs)))
    for line in [options] if isinstance(options, str) else options:
        o.read(line)
    if o.settings.other:
        raise OptionError(f"unknown options: {', '.join(sorted(o.settings.other))}")
    return Built(inputs, o, old, index_dir)
