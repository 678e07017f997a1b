"""The rename journal as tab-separated text, and JSON as the last step of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RENAMES


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Rows of four fields or more, numbered in file order; other lines are skipped. An empty id is null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.split("value", "\t", -1)
    rows = lines.select(F.monotonically_increasing_id().alias("seq"), fields.alias("f")).where(F.size("f") >= 4)
    empty_is_null = lambda c: F.when(c != "", c)
    return rows.select("seq", F.col("f")[0].alias("type"), F.col("f")[1].alias("cls"), empty_is_null(F.col("f")[2]).alias("id"), F.col("f")[3].alias("new_name"))


def write_journal(journal: DataFrame, path: str) -> None:
    """One file in order of ``seq``; tabs and line ends within a field become spaces."""
    clean = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]", " ") for c in RENAMES.names[1:]]
    journal.orderBy("seq").select(F.concat_ws("\t", *clean).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls written out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Class texts from a tree of files named by the class' index in hex."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]+)\.\w+$", 1)
    return files.select(F.conv(F.when(stem != "", stem), 16, 10).cast("long").alias("cls_idx"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def named_by_path(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``texts`` with the class' name, or else the path."""
    return texts.join(classes.select("cls_idx", "fqn"), "cls_idx", "left").withColumn("fqn", F.coalesce("fqn", "path"))
