"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage like a checkpoint does, is columnar, and can
be read again after any executor is lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Rows an Arrow batch may carry; whole texts can be long, so batches are short.
BATCH_ROWS = 1024


def quoted(name: str) -> Column:
    """The column of that very name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on a local master with none set a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bring the package to the workers and bound the rows of an Arrow batch; a smaller setting of the session stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """One run's tables. They go when the session ends, or earlier by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path, files = self._path(self.root)
        files.mkdirs(path)  # what isn't there can't be marked
        files.deleteOnExit(path)

    def _path(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and return the table read back."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(f"{self.root}/{name}")
            files.delete(path, True)
