"""Which entries are written: languages, kinds, roles and extras switched on, as one predicate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.operators.spec import Registry
from symloom.sources.options import Settings


def _sets(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def in_pairs(a: Column, b: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Whether (a, b) is one of the pairs; grouped by the first, so the plan has one test a group."""
    by: dict[str, list[str]] = {}
    for x, y in pairs:
        by.setdefault(x, []).append(y)
    out = F.lit(False)
    for x in sorted(by):
        out = out | ((a == x) & b.isin(sorted(by[x])))
    return F.coalesce(out, F.lit(False))


def kinds_enabled(registry: Registry, language: Column, kind: Column) -> Column:
    """Kinds that are on, by long name or letter; languages that are not registered pass."""
    off = [(s.name, n) for s in registry.specs.values() for k in s.kinds if not k.enabled for n in (k.name, k.letter)]
    return ~in_pairs(language, kind, off)


def languages_enabled(language: Column, settings: Settings) -> Column:
    return F.lit(True) if settings.languages is None else F.coalesce(language.isin(sorted(settings.languages)), F.lit(False))


def roles_enabled(language: Column, kind: Column, roles: Column, settings: Settings) -> Column:
    """Definitions pass; a reference passes if one of its roles is on (or its kind has no switches)."""
    out = F.lit(True)
    for (lang, k), on in settings.roles.items():
        mine = (language == lang) & (F.lit(True) if k == "*" else kind == k)
        fits = F.array_contains(_sets(roles), "def") | F.arrays_overlap(_sets(roles), F.array(*[F.lit(r) for r in sorted(on)]).cast("array<string>"))
        out = out & (~F.coalesce(mine, F.lit(False)) | fits)
    return out


def extras_enabled(extras: Column, settings: Settings) -> Column:
    """Entries whose marks are all switched on; anonymous ones always are."""
    # Letters of the extras.
    letters = {"F": "fileScope", "f": "inputFile", "q": "qualified", "r": "reference", "g": "guest", "s": "subparser"}
    off = [n for x, n in letters.items() if x not in settings.extras]
    return ~F.arrays_overlap(_sets(extras), F.array(*[F.lit(x) for x in off]).cast("array<string>")) if off else F.lit(True)


def writable(registry: Registry, settings: Settings, language: Column, kind: Column, roles: Column, extras: Column, placeholder: Column | None = None) -> Column:
    """All of the above and no placeholder: a conjunction that the optimizer pushes below the rendering."""
    out = languages_enabled(language, settings) & kinds_enabled(registry, language, kind) & roles_enabled(language, kind, roles, settings) & extras_enabled(extras, settings)
    return out & ~F.coalesce(placeholder, F.lit(False)) if placeholder is not None else out


def tag_relative(path: Column, index_dir: Column) -> Column:
    """A path as seen from the directory of the index; both absolute or both relative to one place."""
    from symloom.sources.files import fold_path

    p, d = F.split(fold_path(path), "/"), F.split(fold_path(index_dir), "/")
    d = F.filter(d, lambda x: x != ".")
    n = F.aggregate(F.arrays_zip(F.slice(p, 1, F.size(d)), d), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & x["0"].eqNullSafe(x["1"]), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & x["0"].eqNullSafe(x["1"])).alias("go")), lambda a: a["n"])
    return F.concat(F.repeat(F.lit("../"), F.greatest(F.size(d) - n, F.lit(0))), F.array_join(F.slice(p, n + 1, F.greatest(F.size(p) - n, F.lit(0))), "/"))
