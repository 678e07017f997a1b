"""A loaded corpus and its summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.stored import Stored
from .sources.views import Tables
from .streaming.build import READY, Index


class Session:
    """One corpus at a time; loading another closes the one before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: Tables | Stored | None = None
        self.index: Index | None = None
        self.journal: DataFrame | None = None
        self.cached: list[DataFrame] = []

    def load(self, folder: str, deobf: bool = False) -> DataFrame:
        """Make a folder's tables the current ones; one row of what was loaded.

        A folder with an index, as a build leaves it, gives its own tables, the journal of renames in it and its state;
        any other is taken to hold the star schema's tables. ``deobf`` is noted: names are made where rows come from.
        """
        began = time.time()
        index = Index(self.spark, folder)
        stored = bool(index.meta())
        tables = Stored(self.spark, folder) if stored else Tables(self.spark, folder)
        classes = tables.classes.count()  # an error if there is no such folder
        self.close()
        self.tables, self.index = tables, index if stored else None
        if stored and index.exists("renames"):
            self.journal = tables.renames
        row = (True, classes, folder, bool(deobf), int(1000 * (time.time() - began)), self.state())
        return self.spark.createDataFrame([row], "loaded boolean, classes long, folder string, deobf boolean, load_ms long, index string")

    def state(self) -> str:
        """The state of the index; tables without one are whole."""
        return self.index.state() if self.index else READY

    def current(self) -> Tables | Stored:
        if self.tables is None:
            raise LookupError("nothing is loaded")
        return self.tables

    def info(self) -> DataFrame:
        """Never an error: without a corpus, ``loaded`` is false."""
        if self.tables is None:
            return self.spark.createDataFrame([(False, None, None)], "loaded boolean, folder string, classes long")
        return self.tables.classes.agg(F.lit(True).alias("loaded"), F.lit(self.tables.folder).alias("folder"), F.count("*").alias("classes"))

    def hot(self, df: DataFrame) -> DataFrame:
        """Keep a table that many calls read; memory first, then disk."""
        self.cached.append(df.persist())
        return df

    def clear_cache(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached = []

    def close(self) -> None:
        self.clear_cache()
        self.tables = self.index = self.journal = None
