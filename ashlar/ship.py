"""Getting this package to the Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors a copy of the package's sources, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_ashlar_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="ashlar-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file until then
    archive = os.path.join(folder, "ashlar_sources.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(archive)
    context._ashlar_shipped = True
