"""Global positions in an order without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.storage import materialize


def ranked(df: DataFrame, orders: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order. Rows are split into ranges, numbered within, and shifted by
    the sizes of the ranges before; only one number a range is gathered. Equal keys share a range, so the
    orders should end in a key that tells rows apart."""
    ranges = materialize(df.repartitionByRange(*orders).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*orders))
    return ranges.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, (within + F.col("_before")).cast("long")).drop("_range", "_before")


def latest(entries: DataFrame, keys: list[str] = ["file_id", "entry_id"], order: str = "indexed_at", columns: Sequence[str] | None = None) -> DataFrame:  # noqa: B006
    """One row a key: the one indexed last. Exact and re-indexed duplicates fall away, on the map side first.

    ``columns``: those wanted besides the keys; no other is read or moved. Name them, as the rows of a key
    move as one value that the optimizer cannot take apart.
    """
    rest = [c for c in (entries.columns if columns is None else columns) if c not in keys]
    if not rest:
        return entries.select(*keys).distinct()
    best = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e"))
    return best.select(*keys, *[F.col(f"_e.`{c}`").alias(c) for c in rest])
