"""Names given later, from an append-only journal, applied when rows are read.

A journal row names a class by its key, a member by its owner's key and the rest of its own, a package by its first name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLASS, RENAMES
from .catalog import NotFound, key_of

KINDS = ("CLASS", "METHOD", "FIELD", "PACKAGE")


class Ambiguous(LookupError):
    """Several overloads have the name; ``descriptors`` lists them."""

    def __init__(self, descriptors: list[str]):
        super().__init__("several overloads match; name one by its descriptor")
        self.descriptors = descriptors


def current(journal: DataFrame) -> DataFrame:
    """The last new name of each thing renamed; rows of an unknown kind don't count."""
    known = journal.where(F.col("type").isin(*KINDS))
    return known.groupBy("type", "cls", "id").agg(F.max_by("new_name", "seq").alias("new_name"))


def moved_packages(packages: DataFrame, journal: DataFrame) -> DataFrame:
    """``pkg`` and ``new_pkg`` of every package that is, or is below, a renamed one; the longest renamed prefix counts."""
    renamed = current(journal).where("type = 'PACKAGE'").select(F.col("cls").alias("old"), "new_name")
    parts = F.split("pkg", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    rows = packages.where("pkg IS NOT NULL").select("pkg").distinct().select("pkg", F.explode(prefixes).alias("old"))
    hits = rows.join(renamed, "old").groupBy("pkg").agg(F.max_by(F.struct("old", "new_name"), F.length("old")).alias("hit"))
    return hits.select("pkg", F.concat("hit.new_name", F.expr("substring(pkg, length(hit.old) + 1)")).alias("new_pkg"))


def renamed_classes(classes: DataFrame, journal: DataFrame) -> DataFrame:
    """``classes`` under their current names; keys stay. A class' own name goes before its package's."""
    own = current(journal).where("type = 'CLASS'").select(F.col("cls").alias("dex_id"), F.col("new_name").alias("own_name"))
    out = classes.join(own, "dex_id", "left").join(moved_packages(classes, journal), "pkg", "left")
    moved = F.concat(F.col("new_pkg"), F.expr("substring(fqn, length(pkg) + 1)"))
    package = F.coalesce("new_pkg", "pkg")
    name = F.when(F.col("own_name").isNotNull(), F.concat_ws(".", package, F.col("own_name"))).when(F.col("new_pkg").isNotNull(), moved).otherwise(F.col("fqn"))
    return out.select("cls_idx", "dex_id", name.alias("fqn"), package.alias("pkg"))


def _refs(journal: DataFrame) -> DataFrame:
    """``ref``, the key of a class or member, and its new name."""
    refs = current(journal).where("type != 'PACKAGE'").withColumn("ref", F.when(F.col("type") == "CLASS", F.col("cls")).otherwise(F.concat("cls", F.lit("->"), "id")))
    return refs.where("ref IS NOT NULL").groupBy("ref").agg(F.max("new_name").alias("new_name"))


def _last_segment(display: Column, name: Column, new_name: Column) -> Column:
    """What is shown, with the new name in the place of the old one at its end."""
    return F.when(display.endswith(name), F.concat(F.expr("substring(display, 1, length(display) - length(name))"), new_name)).otherwise(new_name)


def renamed_symbols(symbols: DataFrame, journal: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``symbols`` with current names of classes, methods and fields. With ``classes``, those show their packages' new names too."""
    out = symbols.join(_refs(journal), F.col("dex_id") == F.col("ref"), "left")
    display = F.when(F.col("new_name").isNotNull(), _last_segment(F.col("display"), F.col("name"), F.col("new_name"))).otherwise(F.col("display"))
    if classes is not None:
        now = renamed_classes(classes, journal).select(F.col("dex_id").alias("class_key"), F.col("fqn").alias("class_now"))
        out = out.join(now, (F.col("kind") == CLASS) & (F.col("dex_id") == F.col("class_key")), "left")
        display = F.coalesce("class_now", display)
    return out.select("kind", "dex_id", "cls_dex", F.coalesce("new_name", "name").alias("name"), display.alias("display"))


def renamed_members(members: DataFrame, journal: DataFrame) -> DataFrame:
    """Methods or fields with their current names; keys and descriptors stay."""
    out = members.join(_refs(journal), F.col("dex_id") == F.col("ref"), "left")
    return out.select(*[F.coalesce("new_name", "name").alias("name") if c == "name" else F.col(c) for c in members.columns])


def renamed_bodies(bodies: DataFrame, classes: DataFrame, journal: DataFrame) -> DataFrame:
    """Texts under their classes' current names, or their packages'."""
    now = renamed_classes(classes, journal).select("dex_id", F.col("fqn").alias("fqn_now"))
    changed = classes.join(now, "dex_id").where("fqn != fqn_now").select("fqn", "fqn_now").dropDuplicates(["fqn"])
    out = bodies.join(changed, "fqn", "left").join(moved_packages(bodies, journal), "pkg", "left")
    name = F.coalesce("fqn_now", F.concat("new_pkg", F.expr("substring(fqn, length(pkg) + 1)")), "fqn")
    values = {"fqn": name, "pkg": F.coalesce("new_pkg", "pkg")}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in bodies.columns])


def _entry(journal: DataFrame, type_: str, cls: str, id_: str | None, new_name: str) -> DataFrame:
    """A row to append, numbered after the last."""
    row = journal.sparkSession.createDataFrame([(0, type_, cls, id_, re.sub(r"[\t\r\n]", " ", new_name))], RENAMES)
    last = journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return row.join(F.broadcast(last)).select((F.col("last") + 1).cast("long").alias("seq"), "type", "cls", "id", "new_name")


def rename_class(classes: DataFrame, journal: DataFrame, name: str, new_name: str) -> DataFrame:
    return _entry(journal, "CLASS", key_of(classes, name), None, new_name)


def rename_method(classes: DataFrame, methods: DataFrame, journal: DataFrame, cls: str, method: str, new_name: str, descriptor: str | None = None) -> DataFrame:
    key, short = key_of(classes, cls), method.split("(")[0]
    found = methods.where((F.col("cls_dex") == key) & (F.col("name") == short))
    if descriptor is not None:
        found = found.where(F.col("descriptor") == descriptor)
    some = found.select("descriptor", "dex_id").orderBy("descriptor", "dex_id").limit(100).collect()
    if not some:
        raise NotFound(f"method not found: {cls}.{method}")
    if len(some) > 1:
        raise Ambiguous([r.descriptor for r in some])
    return _entry(journal, "METHOD", key, some[0].dex_id.split("->", 1)[-1], new_name)


def rename_field(classes: DataFrame, fields: DataFrame, journal: DataFrame, cls: str, field: str, new_name: str, key: str | None = None) -> DataFrame:
    """``key`` is the owner's, where the class has no row of its own."""
    key = key or key_of(classes, cls)
    row = fields.where((F.col("cls_dex") == key) & (F.col("name") == field)).orderBy("dex_id").limit(1).first()
    if row is None:
        raise NotFound(f"field not found: {cls}.{field}")
    return _entry(journal, "FIELD", key, row.dex_id.split("->", 1)[-1], new_name)


def rename_package(journal: DataFrame, old: str, new_name: str) -> DataFrame:
    """A package that has been renamed may be named by its present name."""
    before = current(journal).where((F.col("type") == "PACKAGE") & (F.col("new_name") == old)).orderBy("cls").first()
    return _entry(journal, "PACKAGE", before.cls if before else old, None, new_name)
