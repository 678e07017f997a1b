"""Tables in the engine's own schemas, as an index build leaves them in a folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .. import schema


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on a local master with none set a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stored:
    """What ``streaming.build.Index`` wrote. A table that isn't there is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, columns: StructType) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(columns).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], columns)

    @property
    def classes(self) -> DataFrame:
        return self._table("classes", schema.CLASSES)

    @property
    def symbols(self) -> DataFrame:
        return self._table("symbols", schema.SYMBOLS)

    @property
    def edges(self) -> DataFrame:
        return self._table("edges", schema.EDGES)

    @property
    def methods(self) -> DataFrame:
        return self._table("methods", schema.METHODS)

    @property
    def fields(self) -> DataFrame:
        return self._table("fields", schema.FIELDS)

    @property
    def bodies(self) -> DataFrame:
        return self._table("bodies", schema.BODIES)

    @property
    def bodies_by_key(self) -> DataFrame:
        """Texts with their classes' keys."""
        return self.bodies.join(self.classes.select("cls_idx", F.col("dex_id").alias("cls_dex")), "cls_idx")

    @property
    def raw_bodies(self) -> DataFrame:
        return self._table("raw_bodies", schema.BODIES)

    @property
    def literals(self) -> DataFrame:
        return self._table("const_strings", schema.LITERALS)

    @property
    def literal_classes(self) -> DataFrame:
        return self.classes

    @property
    def resources(self) -> DataFrame:
        return self._table("resources", schema.RESOURCES)

    @property
    def renames(self) -> DataFrame:
        return self._table("renames", schema.RENAMES)

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", StructType(schema.POSTINGS.fields).add("bucket", IntegerType()))
