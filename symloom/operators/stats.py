"""Counters: matches of each pattern, files and entries of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.regex import to_java
from symloom.operators.spec import LanguageSpec, Rule


def pattern_counts(lines: DataFrame, rules: list[Rule], line: str = "line") -> DataFrame:
    """``rule, pattern, matched, unmatched``: one pass over the lines, one row a rule."""
    hits = [F.coalesce(F.sum(F.col(line).rlike(to_java(r.pattern, r.icase)).cast("long")), F.lit(0)).alias(f"m{i}") for i, r in enumerate(rules)]
    one = lines.agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.pattern).alias("pattern"), F.col(f"m{i}").alias("matched"), (F.col("n") - F.col(f"m{i}")).alias("unmatched")) for i, r in enumerate(rules)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def language_counts(files: DataFrame, entries: DataFrame, language: str = "lang") -> DataFrame:
    """``lang, files, bytes, tags``: languages of files without entries and of entries without files included."""
    f = files.groupBy(language).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    e = entries.groupBy(language).agg(F.count(F.lit(1)).alias("tags"))
    both = f.join(e, f[language].eqNullSafe(e[language]), "full")
    return both.select(F.coalesce(f[language], e[language]).alias("lang"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("tags", F.lit(0)).alias("tags"))


def description_rows(spec: LanguageSpec) -> list[str]:
    """Header rows that describe the kinds, roles, fields and extras of a language."""
    out = [f"!_TAG_KIND_DESCRIPTION!{spec.name}\t{k.letter},{k.name}\t/{k.description or k.name}/" for k in spec.kinds if k.enabled]
    out += [f"!_TAG_ROLE_DESCRIPTION!{spec.name}!{k.name}\t{r}\t/{r}/" for k in spec.kinds for r in k.roles]
    out += [f"!_TAG_FIELD_DESCRIPTION!{spec.name}\t{f}\t/{d}/" for f, d in spec.fields]
    return out + [f"!_TAG_EXTRA_DESCRIPTION!{spec.name}\t{x}\t/{x}/" for x in spec.extras]
