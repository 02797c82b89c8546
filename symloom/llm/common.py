"""What the operators of this package share: reading tables, Arrow row functions, comment lexers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symloom.sources.parallel import ready, slices, spread

#: Rows and bytes of the Arrow batches that come back; long texts make short batches.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: A key is hot from so many rows, and from a thousandth of all rows: at most a thousand keys are.
HOT_ROWS = 100_000
_HASH_RANGE = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]], scan: bool = False) -> DataFrame:
    """``scan``: ``df`` is a plain scan, which gets enough tasks if it is small. ``make()`` runs once in each task and returns ``f(*values of a row) -> rows``; rows go over Arrow.

    Errors of single rows are not swallowed: ``f`` has to define a result for null and odd values.
    """
    spark = df.sparkSession
    ready(spark)
    if scan:
        df = spread(df)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        out: list[list] = [[] for _ in arrow]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)
            for c in out:
                c.clear()
            return made

        size = 0
        for part in slices(batches):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for made in f(*row):
                    for col, v in zip(out, made, strict=True):
                        col.append(v)
                        if type(v) is str:
                            size += len(v)
                    if len(out[0]) >= BATCH_ROWS or size > BATCH_BYTES:
                        yield batch()
                        size = 0
        yield batch()

    return df.mapInArrow(run, struct)


def hot_join(rows: DataFrame, table: DataFrame, key: str, spread_by: str) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row a key, so that no key keeps a task busy alone.

    Keys of many rows are measured first; there are at most a thousand of them by the threshold. Such a key is
    spread over as many join keys as it has times the threshold, by the hash of ``spread_by``; others are not.
    ``rows`` should be a written table, as it is read twice. Null keys match nothing and are not shuffled for it.
    """
    known = rows.where(F.col(key).isNotNull())
    most = max(HOT_ROWS, known.count() // 1000)
    hot = known.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_slots")).where("_slots > 1")
    hot = [tuple(r) for r in hot.collect()]  # at most a thousand rows, see above
    rest = [c for c in table.columns if c != key]
    if not hot:
        return rows.join(table, key, "left")
    slots = rows.sparkSession.createDataFrame(hot, f"`{key}` {dict(rows.dtypes)[key]}, _slots int")
    one = F.coalesce("_slots", F.lit(1))
    left = known.join(F.broadcast(slots), key, "left").withColumn("_slot", F.pmod(F.xxhash64(spread_by), one).cast("int")).drop("_slots")
    right = table.join(F.broadcast(slots), key, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), one - 1))).drop("_slots")
    joined = left.join(right, [key, "_slot"], "left").drop("_slot").select(*rows.columns, *rest)
    types = dict(table.dtypes)
    return joined.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(types[c]).alias(c) for c in rest]))


def sampled(rows: DataFrame, label: str, key: str, text: str, size: int, chars: int | None = None, least: int = 0) -> list[tuple[str, str]]:
    """About ``size`` texts of each label: those whose hash of ``key`` is least, by a share of the label's rows.

    The hash has 62 bits, so the share is exact for any number of rows and never sinks to nothing. Rows are
    counted without reading a text. ``chars`` bounds what is read of a text, ``least`` leaves shorter ones out.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row a label
    counts = {k: n for k, n in counts.items() if k is not None}
    if not counts:
        return []
    bound = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(_HASH_RANGE * size // max(n, size)).cast("long"))])
    mine = F.pmod(F.xxhash64(key), F.lit(_HASH_RANGE)) < F.element_at(bound, F.col(label))
    taken = rows.where(F.col(text).isNotNull() & (F.length(text) > least) & mine)
    return [tuple(r) for r in taken.select(label, F.substring(text, 1, chars) if chars else F.col(text)).collect()]


def source_files(spark: SparkSession, sf_dir: str, *suffixes: str) -> DataFrame:
    """Readable rows of ``files`` whose path ends in one of the suffixes (letter case aside).

    A file read twice stays two rows with the same contents: results are made distinct per file
    afterwards, which moves a few bytes a row in place of whole texts.
    """
    path = F.lower(F.col("path"))
    some: Column = F.lit(False)
    for s in suffixes:
        some = some | path.endswith(s)
    return table(spark, sf_dir, "files").where(F.col("contents").isNotNull() & F.col("file_id").isNotNull() & some)


def suffix_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


# Strings come first in every alternation, so comment marks inside them are no comments.
_STR = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
LEXERS = {
    "proto": re.compile(_STR + r"|/\*.*?(?:\*/|\Z)|//[^\n]*", re.S),
    "thrift": re.compile(_STR + r"|/\*.*?(?:\*/|\Z)|//[^\n]*|#[^\n]*", re.S),
    "xsl": re.compile(r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)", re.S),
    "el": re.compile(r'\?\\?["\';#(]|"(?:\\.|[^"\\])*(?:"|\Z)|;[^\n]*', re.S),
    "c": re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|/\*.*?(?:\*/|\Z)|//[^\n]*', re.S),
}
LEXERS["h"] = LEXERS["c"]
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|/{2,}!?|#+|;+|\*+/|\*+(?=\s|$|/)|<!--+)?[ \t]*", re.M)
_END = re.compile(r"\s*(?:\*+/|--+>)\s*\Z")


def without_marks(comment: str) -> str:
    """The text of a comment without its marks; line ends stay."""
    return _MARKS.sub("", _END.sub("", comment))


def comments(text: str, kind: str) -> Iterator[tuple[int, int, str, bool]]:
    """Comment blocks of a file: start, end, text without marks, alone (no code on its first line).

    Line comments that stand alone on adjacent lines form one block.
    """
    run: list[str] = []
    start = end = 0
    for m in LEXERS[kind].finditer(text):
        s = m.group()
        if s[0] in "\"'?" or s.startswith("<!["):
            continue
        at = text.rfind("\n", 0, m.start()) + 1
        alone = not text[at : m.start()].strip(" \t﻿\r")
        line = s[0] in "#;" or s.startswith("//")
        if run:
            between = text[end : m.start()]
            if line and alone and between.count("\n") == 1 and not between.strip():
                run.append(s.rstrip("\r"))
                end = m.end()
                continue
            yield start, end, without_marks("\n".join(run)), True
            run = []
        if line and alone:
            run, start, end = [s.rstrip("\r")], m.start(), m.end()
        else:
            yield m.start(), m.end(), without_marks(s.replace("\r", "")), alone
    if run:
        yield start, end, without_marks("\n".join(run)), True
