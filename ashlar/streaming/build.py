"""Building the tables of a corpus, in three phases that can stop and go on.

Structure and usage are written once each and marked complete in ``meta`` when
they are. Texts come as a stream of files that ends when all there is has been
read: the checkpoint knows which files are done, so a later run reads only new
ones, and a run that dies or is cancelled goes on where it was. The main
package's texts can go first, in a stream of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import const_strings, gram_bucket, postings
from ..schema import META, SCHEMA_VERSION
from ..sources.stored import exists, remove

ABSENT, BUILDING, READY, FAILED = "ABSENT", "BUILDING", "READY", "FAILED"
PHASES = ("symbols", "edges")
TEXT_TABLES = ("indexed", "bodies", "const_strings", "postings")


class Index:
    """The tables of one corpus under ``folder``; ``sources.stored.Stored`` reads them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.running: StreamingQuery | None = None
        self.cancelled = False

    def exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}")

    def meta(self) -> dict[str, str]:
        """The last value of each key."""
        if not self.exists("meta"):
            return {}
        rows = self.spark.read.schema(META).parquet(f"{self.folder}/meta").groupBy("k").agg(F.max_by("v", "seq").alias("v")).collect()
        return {r.k: r.v for r in rows}

    def mark(self, **values: str) -> None:
        seq = 0
        if self.exists("meta"):
            seq = self.spark.read.schema(META).parquet(f"{self.folder}/meta").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = [(k, v, seq + 1) for k, v in values.items()]
        self.spark.createDataFrame(rows, META).coalesce(1).write.mode("append").parquet(f"{self.folder}/meta")

    def complete(self) -> bool:
        """Whether a build with this version of the schema has covered everything."""
        meta = self.meta()
        return meta.get("coverage_complete") == "true" and meta.get("schema_version") == str(SCHEMA_VERSION)

    def check_version(self, stamp: str) -> bool:
        """Keep texts made by the same version of what makes them; of another, remove them all, so that they are read again."""
        if (known := self.meta().get("code_version")) == stamp:
            return True
        if known is not None:
            for name in (*TEXT_TABLES, "_checkpoint"):
                remove(self.spark, f"{self.folder}/{name}")
        self.mark(code_version=stamp, coverage_complete="false")
        return False

    def write(self, name: str, df: DataFrame) -> None:
        """A whole table: classes (one row a number), methods, fields, raw_bodies or resources."""
        (df.dropDuplicates(["cls_idx"]) if name == "classes" else df).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def append_edges(self, edges: DataFrame) -> None:
        """More references, to those that are there; repeats stay."""
        edges.write.mode("append").partitionBy("type").parquet(f"{self.folder}/edges")

    def record(self, entry: DataFrame) -> None:
        """Append to the rename journal."""
        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/renames")

    def write_graph(self, symbols: DataFrame, edges: DataFrame) -> list[str]:
        """Phases one and two; what is complete is left as it is. Returns what was written."""
        meta, done = self.meta(), []
        if meta.get("schema_version") not in (None, str(SCHEMA_VERSION)):
            meta = {}  # another version's tables don't count
        for name, df in zip(PHASES, (symbols, edges), strict=True):
            if meta.get(f"{name}_complete") != "true":
                if name == "edges":
                    remove(self.spark, f"{self.folder}/edges")  # begun and not marked
                    self.append_edges(df)
                else:
                    df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
                self.mark(schema_version=str(SCHEMA_VERSION), **{f"{name}_complete": "true"})
                done.append(name)
        return done

    def write_texts(self, bodies_path: str, schema, files_a_batch: int = 64, main_package: str | None = None) -> int:
        """Phase three: texts, literals and postings of all files not read yet. Returns the rows that were new.

        With ``main_package``, its texts and those of packages below it go first. A build keeps to the one it began with.
        """
        self.cancelled = False
        self.mark(coverage_complete="false", failed="false")
        parts: dict[str, object] = {"all": F.lit(True)}
        if main_package is not None:
            inside = F.coalesce((F.col("pkg") == main_package) | F.col("pkg").startswith(f"{main_package}."), F.lit(False))
            parts = {"main": inside, "rest": ~inside}
        new = 0
        try:
            for part, condition in parts.items():
                if not self.cancelled:
                    new += self._stream(bodies_path, schema, files_a_batch, part, condition)
        except Exception:
            self.mark(failed="true")
            raise
        if self.cancelled:
            self.mark(failed="true")
        else:
            self.mark(coverage_complete="true", schema_version=str(SCHEMA_VERSION))
        return new

    def _stream(self, path: str, schema, files_a_batch: int, part: str, condition) -> int:
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).where(condition)
        new: list[int] = []

        def write(batch: DataFrame, number: int) -> None:
            # A batch that is run again writes its own folder again: each row is there once.
            batch = batch.persist()
            new.append(batch.count())
            to = f"batch={part}-{number}"
            batch.select("cls_idx", "fqn", "pkg").write.mode("overwrite").parquet(f"{self.folder}/indexed/{to}")
            batch.write.mode("overwrite").parquet(f"{self.folder}/bodies/{to}")
            const_strings(batch).write.mode("overwrite").parquet(f"{self.folder}/const_strings/{to}")
            write_postings(batch, f"{self.folder}/postings/{to}")
            batch.unpersist()

        self.running = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/_checkpoint/{part}").trigger(availableNow=True).start()
        try:
            self.running.awaitTermination()
        finally:
            self.running = None
        return sum(new)

    def cancel(self) -> None:
        """Stop a build that runs in another thread, after which its state is FAILED; the next run goes on."""
        self.cancelled = True
        if (query := self.running) is not None:
            query.stop()

    def state(self) -> str:
        meta = self.meta()
        if meta.get("coverage_complete") == "true":
            return READY
        return FAILED if meta.get("failed") == "true" else BUILDING if meta else ABSENT

    def status(self, total: int) -> DataFrame:
        """One row, counted from the tables themselves."""
        count = lambda name: self.spark.read.parquet(f"{self.folder}/{name}").count() if self.exists(name) else 0
        state, indexed = self.state(), count("indexed")
        values = {"state": state, "ready": state == READY, "indexed_classes": indexed, "total_classes": total, "percent": percent(indexed, total, state == READY), "symbols": count("symbols"), "edges": count("edges"), "const_strings": count("const_strings"), "coverage_complete": state == READY}
        return self.spark.createDataFrame([tuple(values.values())], list(values))


def write_postings(bodies: DataFrame, path: str) -> None:
    """Postings in a folder for each bucket of trigrams, in order, so that a look-up reads a few row groups."""
    rows = postings(bodies).withColumn("bucket", gram_bucket(F.col("gram")))
    rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def percent(done: int, total: int, ready: bool) -> int:
    return min(100, 100 * done // total) if total else 100 if ready else 0


def status_row(every: DataFrame, done: DataFrame, symbols: DataFrame, edges: DataFrame, literals: DataFrame) -> DataFrame:
    """The status of tables at hand, as one row of a plan."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("total_classes", every), ("indexed_classes", done), ("symbols", symbols), ("edges", edges), ("const_strings", literals))]
    out = counts[0]
    for other in counts[1:]:
        out = out.join(F.broadcast(other))  # one row each
    share = F.when(F.col("total_classes") > 0, F.least(F.lit(100).cast("long"), F.floor(100 * F.col("indexed_classes") / F.col("total_classes")))).otherwise(F.lit(0).cast("long"))
    return out.withColumn("percent", share)
