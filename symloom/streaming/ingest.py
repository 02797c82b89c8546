"""Indexing as files arrive: one micro-batch a trigger, state of a file only, the index updated in place.

Each batch extracts its files and replaces the rows of the same files in a table partitioned by a hash of
their key (the path, or the file id where paths repeat across repos), so that an update rewrites the
touched partitions alone. A batch that is run again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.operators.extract import extract_entries
from symloom.operators.spec import Registry
from symloom.storage import materialize

#: Partitions of an index unless the caller, who knows how large it gets, names another number.
PARTS = 64


class StreamIndexer:
    def __init__(self, spark: SparkSession, registry: Registry, table: str, key: str = "path", parts: int = PARTS) -> None:
        """``key``: the column that tells files apart, ``path`` or ``file_id``. ``parts`` stays what it was at first."""
        self.spark, self.registry, self.table, self.key, self.parts = spark, registry, table, key, parts

    def entries(self) -> DataFrame:
        return self._rows().where("name IS NOT NULL")

    def _rows(self) -> DataFrame:
        """Entries, and a row without a name for each file that was read."""
        return self.spark.read.parquet(self.table)

    def _exists(self) -> bool:
        """Whether the table is there; any failure to find out is an error, not a first batch."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.table)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def update(self, files: DataFrame, batch_id: int = 0) -> None:
        """``files(path, contents, lang, seq)`` and the key: of all reads of one file, in this batch and before,
        the last by ``seq`` counts. Texts are not shuffled: reads are told apart after extraction."""
        key, spark = self.key, self.spark
        rows = files if key == "file_id" else files.withColumn("file_id", F.xxhash64("path"))
        new = materialize(extract_entries(rows, self.registry, carry="seq").withColumn("part", self._part()), "stream-new")
        reads = new.where("name IS NULL").groupBy(key).agg(F.max("seq").alias("seq"))
        old = self._rows() if self._exists() else None
        if old is not None:
            # Only the partitions of the batch are read, and they are written from a copy, not from themselves.
            parts = [r[0] for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
            old = old.where(F.col("part").isin(parts))
            before = old.where("name IS NULL").select(key, F.col("seq").alias("_seq"))
            reads = reads.join(before, key, "left").where("_seq IS NULL OR seq >= _seq").select(key, "seq")
        reads = materialize(reads, "stream-reads")
        # A file read twice at one moment has the same text: its entries are made distinct.
        table = new.join(reads, [key, "seq"], "left_semi").dropDuplicates([key, "entry_id", "name"])
        if old is not None:
            kept = old.join(reads.select(key), key, "left_anti")
            table = materialize(kept.unionByName(table.select(*kept.columns)), "stream-index")
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        try:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            table.repartition("part").sortWithinPartitions("part", "name").write.mode("overwrite").partitionBy("part").parquet(self.table)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def requests(stream: DataFrame, registry: Registry) -> DataFrame:
    """Answers to requests ``(request_id, filename, contents, lang)``: entries, then one row that says it is done.

    Contents come with the request, no file is opened; a request without contents or of an unknown language
    gets an error row.
    """
    ok = F.col("contents").isNotNull() & F.col("lang").isin(list(registry.specs))
    asked = stream.withColumn("ok", F.coalesce(ok, F.lit(False)))
    rows = asked.where("ok").select(F.col("request_id").alias("file_id"), F.col("filename").alias("path"), "contents", "lang")
    found = extract_entries(rows, registry).select(F.col("file_id").alias("request_id"), F.lit("tag").alias("type"), "name", "kind", "line")
    done = asked.select("request_id", F.when(F.col("ok"), "completed").otherwise("error").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("line"))
    return found.unionByName(done)
