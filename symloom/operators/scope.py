"""Relations between entries of one file: scopes, ordinals, enclosing intervals, lookups, statistics.

Every operator is keyed by the file, so rows of one file meet in one place and no join goes across files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.storage import materialize



def qualified_names(entries: DataFrame, separators: DataFrame | None = None, default: str = ".", depth: int | None = None, file: str = "file_id", placeholder: str | None = None) -> DataFrame:
    """Adds ``fqn``: names of all ancestors and the own one, joined by the separator of each pair of kinds.

    ``entries(file, entry_id, scope_id, name, kind)``. Parents are found by jumping: each round joins every
    entry with the ancestor that its current one points to, so a chain of n scopes takes log2(n) joins on
    the same key. ``depth`` bounds the chains if it is known; without it rounds go on until every chain has
    ended. Placeholders lend no name. An entry that is its own ancestor stops there; without a depth, entries
    whose chain runs into a loop count as having no scope.
    """
    hidden = F.coalesce(F.col(placeholder), F.lit(False)) if placeholder else F.lit(False)
    base = entries.select(file, "entry_id", "scope_id", "name", "kind", hidden.alias("_hidden"))
    rounds = max(1, (max(1, depth) - 1).bit_length()) if depth is not None else 0
    if depth is None:
        base, rounds = _without_loops(base, file)
    parent = base.select(F.col(file), F.col("entry_id").alias("scope_id"), F.col("kind").alias("_pkind"), F.col("name").alias("_pname"), F.col("_hidden").alias("_phidden"))
    own = base.where(F.col("scope_id").isNull() | (F.col("scope_id") != F.col("entry_id"))).join(parent, [file, "scope_id"], "left")
    if separators is not None:
        sep = separators.select(F.col("parent_kind").alias("_pkind"), F.col("kind"), F.col("separator").alias("_sep"))
        own = own.join(F.broadcast(sep) if _small(separators) else sep, ["_pkind", "kind"], "left")
    else:
        own = own.withColumn("_sep", F.lit(None).cast("string"))
    head = F.when(F.col("_pname").isNull() | F.col("_phidden"), F.lit("")).otherwise(F.concat("_pname", F.coalesce("_sep", F.lit(default))))
    step = own.select(file, "entry_id", F.col("scope_id").alias("up"), head.alias("prefix"))
    for _ in range(rounds):
        above = step.select(F.col(file), F.col("entry_id").alias("up"), F.col("up").alias("_up2"), F.col("prefix").alias("_prefix2"))
        step = step.join(above, [file, "up"], "left").select(file, "entry_id", F.col("_up2").alias("up"), F.concat(F.coalesce("_prefix2", F.lit("")), "prefix").alias("prefix"))
    return entries.join(step.select(file, "entry_id", "prefix"), [file, "entry_id"], "left").withColumn("fqn", F.concat(F.coalesce("prefix", F.lit("")), "name")).drop("prefix")


def _without_loops(base: DataFrame, file: str) -> tuple[DataFrame, int]:
    """``base`` with the scopes of looping chains emptied, and the rounds of doubling that the longest chain takes."""
    base = materialize(base, "scopes")
    longest = base.groupBy(file).count().agg(F.max("count")).first()[0] or 1
    jump = base.where("scope_id IS NOT NULL AND scope_id <> entry_id").select(file, "entry_id", F.col("scope_id").alias("up"))
    rounds = 0
    # A chain that has not ended after as many steps as its file has entries is a loop.
    while rounds <= int(longest).bit_length():
        jump = materialize(jump, "scope-jumps")
        if jump.limit(1).count() == 0:
            return base, max(1, rounds)
        above = jump.select(F.col(file), F.col("entry_id").alias("up"), F.col("up").alias("_up"))
        jump = jump.join(above, [file, "up"]).select(file, "entry_id", F.col("_up").alias("up"))
        rounds += 1
    looped = jump.select(file, "entry_id").distinct().withColumn("_loop", F.lit(True))
    cut = base.join(looped, [file, "entry_id"], "left").withColumn("scope_id", F.when(F.col("_loop").isNull(), F.col("scope_id"))).drop("_loop")
    return cut.select(*base.columns), rounds


def _small(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of settings is as small as it should be, before it is broadcast."""
    return df.limit(most + 1).count() <= most


def qualified_rows(entries: DataFrame) -> DataFrame:
    """The entries and, for each one in a scope, a further row under its qualified name."""
    extra = entries.where(F.col("fqn") != F.col("name")).withColumn("name", F.col("fqn"))
    if "extras" in entries.columns:
        extra = extra.withColumn("extras", F.array_union(F.coalesce("extras", F.array().cast("array<string>")), F.array(F.lit("qualified"))))
    return entries.unionByName(extra)


def with_nth(entries: DataFrame, file: str = "file_id", scope: Column | str = "scope_id", order: str = "entry_id") -> DataFrame:
    """Adds ``nth``: the place among the entries of the same scope, from 0."""
    s = F.col(scope) if isinstance(scope, str) else scope
    return entries.withColumn("nth", F.row_number().over(Window.partitionBy(F.col(file), s).orderBy(order)) - 1)


def with_inferred_end(entries: DataFrame, lines: DataFrame | None = None, file: str = "file_id") -> DataFrame:
    """``end`` where it is missing: the line before the next entry of the file, or its last line."""
    w = Window.partitionBy(file).orderBy("line", "entry_id")
    nxt = F.lead("line").over(w)
    if lines is not None:
        last = lines.groupBy(file).agg(F.max("line_no").alias("_last"))
        entries = entries.join(last, file, "left")
    else:
        entries = entries.withColumn("_last", F.lit(None).cast("long"))
    return entries.withColumn("end", F.coalesce("end", F.greatest(nxt - 1, F.col("line")), "_last")).drop("_last")


def enclosing(points: DataFrame, entries: DataFrame, file: str = "file_id", line: str = "line_no", bucket: int = 64) -> DataFrame:
    """For each point the last entry by (line, entry_id) whose interval holds its line; points in none are kept.

    A range join on the file and the bucket of lines: an interval is listed in each bucket that it meets, so
    a hot file splits into buckets and no pair outside a bucket is formed. Equal points become one.
    """
    spans = entries.where(F.col("end") > F.col("line")).select(F.col(file), F.col("line").alias("_lo"), F.col("end").alias("_hi"), F.col("entry_id").alias("_id"), F.col("name").alias("_name"))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor(F.col("_hi") / bucket))))
    p = points.withColumn("_b", F.floor(F.col(line) / bucket))
    hit = p.join(spans, [file, "_b"], "left").withColumn("_in", F.when((F.col(line) >= F.col("_lo")) & (F.col(line) <= F.col("_hi")), F.struct("_lo", "_id", "_name")))
    best = hit.groupBy(*points.columns).agg(F.max("_in").alias("_best"))
    return best.select(*points.columns, F.col("_best._id").alias("enclosing_id"), F.col("_best._name").alias("enclosing_name"))


def lookup_last(entries: DataFrame, keys: DataFrame, on: list[str], order: str = "entry_id") -> DataFrame:
    """For each key the last entry with it; the entries are reduced before they meet the keys."""
    rest = [c for c in entries.columns if c not in on]
    last = entries.groupBy(*on).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e"))
    return keys.join(last, on).select(*keys.columns, *[F.col(f"_e.`{c}`").alias(c) for c in rest])


def ancestors(entries: DataFrame, depth: int | None = None, file: str = "file_id") -> DataFrame:
    """``file, entry_id, ancestor, distance``: every entry with itself (0), its scope (1), and so on up to the
    file itself (null). Found by doubling: log2(depth) joins, each along a chain twice as long; without a
    depth until no chain grows."""
    direct = entries.where(F.col("scope_id").isNull() | (F.col("scope_id") != F.col("entry_id"))).select(file, "entry_id", F.col("scope_id").alias("ancestor"), F.lit(1).alias("distance"))
    reach, reached = direct, 1
    while depth is None or reached < depth:
        if depth is None:
            reach = materialize(reach, "ancestors")
            if reach.where((F.col("distance") == reached) & F.col("ancestor").isNotNull()).limit(1).count() == 0:
                break
        more = reach.where("ancestor IS NOT NULL").join(reach.select(file, F.col("entry_id").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d")), [file, "ancestor"])
        # Pairs as long as the known reach lengthen it; shorter ones are known already.
        far = more.select(file, "entry_id", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance")).where(F.col("distance") > reached)
        # The nearest way to each ancestor counts, so a loop adds nothing after one turn.
        reach = reach.unionByName(far).groupBy(file, "entry_id", "ancestor").agg(F.min("distance").alias("distance"))
        reached *= 2
    own = entries.select(file, "entry_id", F.col("entry_id").cast(dict(direct.dtypes)["ancestor"]).alias("ancestor"), F.lit(0).alias("distance"))
    return own.unionByName(reach if depth is None else reach.where(F.col("distance") <= depth))


def resolve(entries: DataFrame, refs: DataFrame, depth: int | None = None, file: str = "file_id") -> DataFrame:
    """For each reference ``(file, ref_id, scope_id, name)`` the entry of that name in the nearest scope outward;
    of several in one scope the last. References without an entry are left out."""
    up = ancestors(entries, depth, file).select(file, F.col("entry_id").alias("scope_id"), F.col("ancestor").alias("_s"), F.col("distance").alias("_d"))
    seen = refs.where("scope_id IS NOT NULL").join(up, [file, "scope_id"]).unionByName(refs.where("scope_id IS NULL").withColumns({"_s": F.col("scope_id"), "_d": F.lit(0)}).select(file, "scope_id", *[c for c in refs.columns if c not in (file, "scope_id")], "_s", "_d"))
    e = entries.select(F.col(file).alias("_f"), F.col("scope_id").alias("_es"), F.col("name").alias("_n"), F.col("entry_id").alias("target_id"))
    hit = seen.join(e, (F.col(file) == F.col("_f")) & F.col("_s").eqNullSafe(F.col("_es")) & (F.col("name") == F.col("_n")))
    best = hit.groupBy(file, "ref_id").agg(F.max_by("target_id", F.struct(-F.col("_d"), F.col("target_id"))).alias("target_id"))
    return best


def count_in_scope(entries: DataFrame, file: str = "file_id", scope: str = "scope_name", definitions_only: bool = False) -> DataFrame:
    d = entries.where(F.array_contains(F.coalesce("role_list", F.array(F.lit("def"))), "def")) if definitions_only else entries
    return d.where(F.col(scope).isNotNull()).groupBy(file, scope).agg(F.count(F.lit(1)).alias("n"))


def line_count(text: Column) -> Column:
    """Lines of a text; a last line without an end counts, an empty text has none."""
    n = F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(n).cast("long")


def totals(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files, lines, bytes and entries in one row; ``files(lines, bytes)`` has one row a file."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    e = entries.agg(F.count(F.lit(1)).alias("tags"), F.max(F.octet_length("tag_name")).alias("longest_name"))
    return f.crossJoin(e)  # one row with one row


def merge_roles(*columns: Column) -> Column:
    """The union of role or extra sets; null is the empty set."""
    empty = F.array().cast("array<string>")
    return reduce(F.array_union, [F.coalesce(c, empty) for c in columns])
