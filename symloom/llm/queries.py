"""The queries of this package, by name; ``oracle_sql`` holds SQL where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import source_files, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.licenses import license_verdicts

    return license_verdicts(source_files(spark, sf_dir, ".proto", ".thrift", ".xsl"), table(spark, sf_dir, "repos"), table(spark, sf_dir, "licenses"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.docpairs import documented_functions

    return documented_functions(source_files(spark, sf_dir, ".thrift", ".el"), with_code=False)


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.docpairs import documented_functions

    return documented_functions(source_files(spark, sf_dir, ".thrift", ".el"))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.split("path", "/"), -1).isin("input0.pm", "input1.pm")
    return source_files(spark, sf_dir, ".pm").where(named).selectExpr("file_id as id", "contents as text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.sharedspans import shared_pairs

    return shared_pairs(_modules(spark, sf_dir))


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.sharedspans import shared_spans

    return shared_spans(_modules(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_shares(spark, sf_dir).select("file_id", "lang")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.naturaltext import language_shares

    return language_shares(source_files(spark, sf_dir, ".thrift", ".el"), table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_reasons(spark, sf_dir).select("file_id")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.handwritten import not_handwritten

    return not_handwritten(source_files(spark, sf_dir, ".c", ".h"), table(spark, sf_dir, "upstream_files"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.packing import unused

    return unused(p6_containers(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.mixing import Mix

    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).chosen()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.mixing import Mix

    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symloom.llm.stuffing import spam_pages

    return spam_pages(table(spark, sf_dir, "documents"))


# --- what SQL can check of these operators: counts, bounds and sums that must come out -----------------------


def p1_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject has one verdict: how many there are of each kind, and how many verdicts are no known form."""
    found, book = p1_found(spark, sf_dir), table(spark, sf_dir, "licenses").select(F.col("license_id").alias("part"))
    parts = found.select("subject_kind", "subject_id", F.explode(F.split("verdict", " OR ")).alias("part"))
    odd = parts.where(~F.col("part").isin("CONFLICT", "UNKNOWN")).join(book, "part", "left_anti").groupBy("subject_kind").agg(F.count(F.lit(1)).alias("odd"))
    counts = found.groupBy("subject_kind").agg(F.count(F.lit(1)).alias("subjects"), F.count_distinct("subject_id").alias("ids"))
    return counts.join(odd, "subject_kind", "left").select("subject_kind", "subjects", "ids", F.coalesce("odd", F.lit(0)).alias("odd"))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with their length and how many modules have the same text; what is shared lies within the text."""
    spans = p3_spans(spark, sf_dir)
    within = F.forall("spans", lambda x: (x["start"] >= 0) & (x["stop"] <= F.col("n_chars")) & (x["stop"] - x["start"] >= 200))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return spans.select(F.col("id").alias("file_id"), F.col("n_chars").cast("long").alias("n_chars"), "copies", (within & (total == F.col("shared_chars"))).alias("sound"))


def p5_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files found those that a third-party directory shows."""
    from symloom.llm.handwritten import THIRD_PARTY

    files = source_files(spark, sf_dir, ".c", ".h").select("file_id", F.split(F.lower("path"), "/").alias("parts"))
    shown = files.where(F.exists(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: x.isin(sorted(THIRD_PARTY)))).select("file_id").distinct()
    return p5_found(spark, sf_dir).join(shown, "file_id", "left_semi")


def p6_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: documents placed, and containers whose tokens, separators and free space are not their capacity."""
    specs = table(spark, sf_dir, "pack_specs")
    placed = p6_containers(spark, sf_dir)
    per = placed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("container_free").alias("free"), F.max("container_free").alias("most"))
    off = F.col("tokens") + F.col("free") + (F.col("n") - 1) * F.coalesce("separator_tokens", F.lit(0)) != F.col("capacity_tokens")
    broken = per.join(specs, "spec_id").groupBy("spec_id").agg(F.sum((off | (F.col("free") != F.col("most"))).cast("long")).alias("broken"))
    documents = placed.groupBy("spec_id").agg(F.count_distinct("doc_id").alias("documents"))
    return documents.join(broken, "spec_id").select("spec_id", "documents", "broken")


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: whether no row is used too often, and whether its share is within half a hundredth of its target."""
    s = p7_shares(spark, sf_dir)
    near = F.abs(F.col("expected_share") - F.col("target_share")) <= 0.005
    return s.select("mix_source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("kept"), near.alias("near"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from symloom.llm.handwritten import THIRD_PARTY

    named = ", ".join(f"'{x}'" for x in sorted(THIRD_PARTY))
    modules = "SELECT DISTINCT file_id, contents FROM files WHERE contents IS NOT NULL AND string_split(path, '/')[-1] IN ('input0.pm', 'input1.pm')"
    return {
        "p1_subjects": "SELECT 'file' AS subject_kind, count(DISTINCT file_id) AS subjects, count(DISTINCT file_id) AS ids, 0 AS odd FROM files WHERE contents IS NOT NULL AND regexp_matches(lower(path), '\\.(proto|thrift|xsl)$') UNION ALL SELECT 'repo', count(DISTINCT repo_id), count(DISTINCT repo_id), 0 FROM repos",
        "p3_copies": f"SELECT file_id, CAST(length(contents) AS BIGINT) AS n_chars, count(*) OVER (PARTITION BY contents) AS copies, true AS sound FROM ({modules})",
        "p5_by_directory": f"SELECT DISTINCT file_id FROM files WHERE contents IS NOT NULL AND regexp_matches(lower(path), '\\.[ch]$') AND list_has_any(list_slice(string_split(lower(path), '/'), 1, -2), [{named}])",
        "p6_balance": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS broken FROM pack_specs",
        "p7_bounds": "SELECT lower(trim(mix_source)) AS mix_source, target_share, max_repeats, true AS kept, true AS near FROM mix_targets",
    }
