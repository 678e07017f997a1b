"""Who refers to what: joins of the reference multigraph with its symbols.

All take and return DataFrames. A pivot is a class' or member's key, or a
DataFrame with the column ``dex_id``; the small pivot side is a filter, and the
optimizer pushes it through the views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CALLS, EXTENDS, IMPLEMENTS, KIND_NAMES, RELATION_NAMES, USES_CLASS, USES_FIELD


def kind_name(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in KIND_NAMES.items():
        out = F.when(kind == code, name).otherwise(out)
    return out


def relation_name(type_: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in RELATION_NAMES.items():
        out = F.when(type_ == code, name).otherwise(out)
    return out


def _members(df: DataFrame) -> DataFrame:
    return df.select(kind_name(F.col("kind")).alias("kind"), "name", "display", F.col("cls_dex").alias("class"))


def _ends(edges: DataFrame, type_: int, pivot: str, pivots: str | DataFrame) -> DataFrame:
    edges = edges.where(F.col("type") == type_)
    if isinstance(pivots, str):
        return edges.where(F.col(pivot) == pivots)
    return edges.join(pivots.select(F.col("dex_id").alias(pivot)), pivot)


def incoming(symbols: DataFrame, edges: DataFrame, type_: int, dst: str | DataFrame) -> DataFrame:
    """kind, name, display and class of what refers to the pivot; one row a reference."""
    return _members(_ends(edges, type_, "dst", dst).join(symbols, F.col("src") == symbols.dex_id))


def outgoing(symbols: DataFrame, edges: DataFrame, type_: int, src: str | DataFrame) -> DataFrame:
    """kind, name, display and class of what the pivot refers to; one row a reference."""
    return _members(_ends(edges, type_, "src", src).join(symbols, F.col("dst") == symbols.dex_id))


def class_users(classes: DataFrame, symbols: DataFrame, edges: DataFrame, dst: str) -> DataFrame:
    """The distinct classes that use a class, by name or else by key; a class may use itself."""
    owners = _ends(edges, USES_CLASS, "dst", dst).join(symbols, F.col("src") == symbols.dex_id).select("cls_dex").distinct()
    return _named(owners, classes)


def call_graph(classes: DataFrame, symbols: DataFrame, edges: DataFrame, cls: str) -> DataFrame:
    """The distinct other classes whose methods a class' methods call: one step."""
    callers = symbols.where(F.col("cls_dex") == cls).select(F.col("dex_id").alias("src"))
    callees = symbols.select(F.col("dex_id").alias("dst"), "cls_dex").where(F.col("cls_dex") != cls)
    called = edges.where(F.col("type") == CALLS).join(callers, "src").join(callees, "dst").select("cls_dex").distinct()
    return _named(called, classes)


def _named(owners: DataFrame, classes: DataFrame) -> DataFrame:
    """``class``: the name, or the key of a class without one. Distinct by name and key together."""
    named = owners.join(classes.select("dex_id", "fqn"), owners.cls_dex == F.col("dex_id"), "left")
    return named.select("cls_dex", "fqn").distinct().select(F.coalesce("fqn", "cls_dex").alias("class"))


def subtypes(symbols: DataFrame, edges: DataFrame, sup: str) -> DataFrame:
    """Direct subtypes of a class or interface and how they relate; none for an unknown name."""
    below = edges.where(F.col("type").isin(EXTENDS, IMPLEMENTS) & (F.col("dst") == sup))
    named = below.join(symbols.select("dex_id", "display", "cls_dex"), F.col("src") == F.col("dex_id"))
    return named.select(F.coalesce("display", "cls_dex").alias("class"), relation_name(F.col("type")).alias("relation"))


def subtypes_by_super(edges: DataFrame) -> DataFrame:
    """Every super type with the sorted list of its direct subtypes."""
    return edges.where(F.col("type").isin(EXTENDS, IMPLEMENTS)).groupBy(F.col("dst").alias("super")).agg(F.sort_array(F.collect_set("src")).alias("subs"))


def xrefs_to_method(methods: DataFrame, symbols: DataFrame, edges: DataFrame, cls: str, name: str, descriptor: str | None = None) -> DataFrame:
    """Callers of all overloads of a method together; none for an unknown method."""
    return incoming(symbols, edges, CALLS, _overloads(methods, cls, name, descriptor))


def xrefs_from_method(methods: DataFrame, symbols: DataFrame, edges: DataFrame, cls: str, name: str, descriptor: str | None = None) -> DataFrame:
    return outgoing(symbols, edges, CALLS, _overloads(methods, cls, name, descriptor))


def _overloads(methods: DataFrame, cls: str, name: str, descriptor: str | None) -> DataFrame:
    found = methods.where((F.col("cls_dex") == cls) & (F.col("name") == name))
    return found if descriptor is None else found.where(F.coalesce("descriptor", "name") == descriptor)


def xrefs_to_field(fields: DataFrame, symbols: DataFrame, edges: DataFrame, cls: str, name: str) -> DataFrame:
    """Users of the first field of that name; reads and writes alike."""
    field = fields.where((F.col("cls_dex") == cls) & (F.col("name") == name)).orderBy("dex_id").limit(1)
    return incoming(symbols, edges, USES_FIELD, field)


def edge_stats(edges: DataFrame) -> DataFrame:
    """References and distinct pairs of each type: the graph is a multigraph."""
    pairs = edges.groupBy("type", "src", "dst").agg(F.count("*").alias("n"))
    return pairs.groupBy("type").agg(F.sum("n").alias("edges"), F.count("*").alias("pairs"))


def symbol_stats(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(kind_name(F.col("kind")).alias("kind")).agg(F.count("*").alias("symbols"), F.count_distinct("cls_dex").alias("owners"))


def export_usage(adjacency: DataFrame, type_: int) -> DataFrame:
    """Edges from rows of a node and the list of those that use it: the user is the source."""
    rows = adjacency.select(F.explode("users").alias("src"), F.col("node").alias("dst"))
    return rows.where("src IS NOT NULL AND dst IS NOT NULL").withColumn("type", F.lit(type_))


def first_symbols(candidates: DataFrame) -> DataFrame:
    """One symbol for each key: the first by ``seq``."""
    rest = [c for c in candidates.columns if c not in ("dex_id", "seq")]
    return candidates.groupBy("dex_id").agg(F.min_by(F.struct(*rest), "seq").alias("s")).select("dex_id", "s.*")
