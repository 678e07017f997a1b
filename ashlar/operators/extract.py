"""Facts out of markup and source text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.strings import STRING_RESOURCE, trim_controls
from ..ship import ship

NAME = "@*[name()='android:name']"
MAIN = f"intent-filter[action/{NAME}='android.intent.action.MAIN' and category/{NAME}='android.intent.category.LAUNCHER']"


def string_resources(resources: DataFrame, suffix: str = "strings.xml", pattern: str = STRING_RESOURCE) -> DataFrame:
    """name and value of every element in all resources whose name ends so; entities stay as written."""
    files = resources.where(F.col("name").endswith(suffix)) if suffix else resources
    names, values = (F.regexp_extract_all("content", F.lit(pattern), F.lit(k)) for k in (1, 2))
    rows = files.select(F.col("name").alias("resource"), F.posexplode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("pos", "e"))
    return rows.select("resource", "pos", F.col("e.name").alias("name"), trim_controls(F.col("e.value")).alias("value"))


def _guarded(xml: Column, value: Column) -> Column:
    """Nothing is read from a document that declares a type: its entities could stand for anything."""
    return F.when(xml.isNotNull() & ~F.contains(xml, F.lit("<!DOCTYPE")), value)


def manifest_package(xml: Column) -> Column:
    found = F.xpath_string(xml, F.lit("/manifest/@package"))
    return _guarded(xml, F.when(found != "", found))


def main_activity(xml: Column) -> Column:
    """The first activity, or else alias, that a launcher starts by a filter of its own; relative names get the package."""
    package = manifest_package(xml)
    found = F.lit(None).cast("string")
    for tag in ("activity-alias", "activity"):  # the last is tried first
        for attribute in ("@name", NAME):
            name = F.xpath_string(xml, F.lit(f"(//{tag}[{MAIN}])[1]/{attribute}"))
            found = F.when(name != "", name).otherwise(found)
    full = F.when(found.startswith("."), F.concat(package, found)).when(~F.contains(found, F.lit(".")), F.concat(package, F.lit("."), found)).otherwise(found)
    return _guarded(xml, F.coalesce(full, found))


def launcher(manifests: DataFrame) -> DataFrame:
    """main_activity and package of each manifest, with notes where there is none."""
    xml = F.col("content")
    return manifests.select("name", F.coalesce(main_activity(xml), F.lit("no launcher activity found")).alias("main_activity"), F.coalesce(manifest_package(xml), F.lit("?")).alias("package"))


def slice_method(source: str | None, name: str | None) -> str | None:
    """The text from the line of a method's first mention as a declaration or call to the brace that closes it.

    Braces are counted wherever they stand. Without a brace the slice ends 200
    characters on; without its end, 400 after the first brace.
    """
    if source is None or name is None:
        return None
    at = source.find(f" {name}(")
    if at < 0:
        return None
    start = source.rfind("\n", 0, at) + 1
    opening = source.find("{", at)
    if opening < 0:
        return source[start : at + 200]
    depth = 0
    for k in range(opening, len(source)):
        depth += (source[k] == "{") - (source[k] == "}")
        if not depth:
            return source[start : k + 1]
    return source[start : opening + 400]


@F.pandas_udf(StringType())
def _slices(source: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([slice_method(s, n) for s, n in zip(source, name, strict=True)], dtype=object)


def with_method_slice(df: DataFrame, source: str, name: str, out: str) -> DataFrame:
    """``df`` with the slice. Brace depth is beyond patterns, so this one runs in Python, on Arrow batches."""
    ship(df.sparkSession)
    return df.withColumn(out, _slices(F.col(source), F.col(name)))


def methods_by_name(methods: DataFrame, bodies: DataFrame, cls: str, name: str, descriptor: str | None = None) -> DataFrame:
    """name, descriptor and code of the overloads; ``bodies`` has ``cls_dex`` and ``body``. All overloads get the first one's slice."""
    found = methods.where((F.col("cls_dex") == cls) & (F.col("name") == name))
    if descriptor is not None:
        found = found.where(F.col("descriptor") == descriptor)
    both = found.join(bodies.select("cls_dex", "body"), "cls_dex", "left")
    return with_method_slice(both, "body", "name", "code").select("name", "descriptor", "code")
