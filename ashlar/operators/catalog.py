"""Enumerations, look-ups by name and counts over classes, members and resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import contains_folded
from .paging import first


class NotFound(LookupError):
    """Nothing has the name asked for."""


def resolve_class(classes: DataFrame, name: str) -> DataFrame:
    """The class with that current name, or else with that key; no row if there is none."""
    found = classes.where((F.col("fqn") == name) | (F.col("dex_id") == name))
    rank = F.when(F.col("fqn") == name, 0).otherwise(1)
    return found.orderBy(rank, F.desc("cls_idx")).limit(1)


def key_of(classes: DataFrame, name: str) -> str:
    """The key of the class, which must exist."""
    row = resolve_class(classes, name).select("dex_id").first()
    if row is None:
        raise NotFound(f"class not found: {name}")
    return row.dex_id


def package_tree(classes: DataFrame) -> DataFrame:
    """Classes by package; a class without one counts under the empty name."""
    return classes.groupBy(F.coalesce("pkg", F.lit("")).alias("package")).agg(F.count("*").alias("classes"))


def methods_of_class(methods: DataFrame, cls: str) -> DataFrame:
    rows = methods.where(F.col("cls_dex") == cls)
    return rows.select("name", F.coalesce("descriptor", "name").alias("descriptor"), "return_type", "constructor")


def fields_of_class(fields: DataFrame, cls: str) -> DataFrame:
    return fields.where(F.col("cls_dex") == cls).select("name", "type")


def text_of(classes: DataFrame, bodies: DataFrame, name: str) -> DataFrame:
    """The text of the class with that name or key, or else under that name; NotFound without a row or a text."""
    row = resolve_class(classes, name).select("fqn").first()
    found = bodies.where(F.col("fqn") == (row.fqn if row else name)).orderBy("cls_idx").limit(1).select(F.col("fqn").alias("class"), F.col("body").alias("source"))
    one = found.first()
    if one is None:
        raise NotFound(f"class not found: {name}" if row is None else f"no text of class: {name}")
    if one.source is None:
        raise NotFound(f"no text of class: {name}")
    return found


def body_of_class(bodies: DataFrame, cls_idx: int) -> DataFrame:
    """The text of a class; a null text stays null."""
    return bodies.where(F.col("cls_idx") == cls_idx).select(F.col("fqn").alias("class"), F.col("body").alias("source"))


def search_classes(classes: DataFrame, keyword: str, limit: object = 200) -> DataFrame:
    """Names that hold the keyword, case aside, in class order."""
    found = classes.where(contains_folded(F.col("fqn"), keyword))
    return first(found, limit, "cls_idx", "fqn").select(F.col("fqn").alias("class"))


def search_methods(classes: DataFrame, methods: DataFrame, name: str, limit: object = 200) -> DataFrame:
    """Methods whose name holds the word, case aside."""
    found = methods.where(contains_folded(F.col("name"), name))
    named = found.join(classes.select(F.col("dex_id").alias("cls_dex"), "fqn"), "cls_dex", "left")
    rows = named.select(F.coalesce("fqn", "cls_dex").alias("class"), F.col("name").alias("method"), F.coalesce("descriptor", "name").alias("descriptor"))
    return first(rows, limit, "class", "method", "descriptor")


def resource(resources: DataFrame, name: str) -> DataFrame:
    """The first resource of that very name; no row if there is none."""
    return resources.where(F.col("name") == name).orderBy("content").limit(1)


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet."""
    return every.join(done.select(key), key, "left_anti")


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()
