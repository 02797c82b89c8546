"""What row-by-row work in Python needs: enough tasks over small scans, and workers that know the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Files of more bytes are never dealt out anew.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan without a shuffle, in at least as many partitions as there are cores.

    A small table may lie in one row group and then keeps one core busy. Only such a table, of at most
    ``SPREAD_BYTES`` and fewer splits than cores, is dealt out anew; a large one is read as it lies.
    """
    plan = df._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = plan.executedPlan().execute().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def slices(batches, rows: int = 1000, size: int = 32 << 20):
    """Arrow batches cut into pieces of bounded rows and bytes, whatever the session's batch size is."""
    for b in batches:
        n = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


_READY: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Sees to it that the Python workers can import this package, once an application.

    Where it is not installed on them (one task asks), the package is sent as a zip file.
    """
    sc = spark.sparkContext
    if sc.applicationId in _READY:
        return

    def has_it(_):
        import importlib.util

        return importlib.util.find_spec("symloom") is not None

    if not sc.parallelize([0], 1).map(has_it).first():
        root = Path(__file__).resolve().parents[1]
        kept = Path(tempfile.mkdtemp(prefix="symloom-")) / "symloom.zip"  # on the driver, which serves it
        with zipfile.ZipFile(kept, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        atexit.register(shutil.rmtree, kept.parent, True)
        sc.addPyFile(str(kept))
    _READY.add(sc.applicationId)
