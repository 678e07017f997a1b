"""The code-knowledge tables over a star schema's tables.

Customers, suppliers, nations, regions and segments stand for classes, orders and
(supplier, part) pairs for methods, parts for fields of their brand. Documents are
class texts, pages are resources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import const_strings
from ..schema import CALLS, CLASS, EXTENDS, FIELD, IMPLEMENTS, METHOD, RENAMES, USES_CLASS, USES_FIELD


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Tables:
    """Lazy views of one folder of Parquet tables. Each is a plan: what a query doesn't need isn't read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def classes(self) -> DataFrame:
        customers = self.read("customer").select(
            F.col("c_custkey").cast("long").alias("cls_idx"),
            _id("C", "c_custkey").alias("dex_id"),
            F.concat(F.lit("cust."), "c_mktsegment", F.lit("."), "c_name").alias("fqn"),
            F.concat(F.lit("cust."), "c_mktsegment").alias("pkg"),
        )
        suppliers = self.read("supplier").select(
            (F.col("s_suppkey") + 1_000_000_000).cast("long").alias("cls_idx"), _id("S", "s_suppkey").alias("dex_id"), F.concat(F.lit("supp."), "s_name").alias("fqn"), F.lit("supp").alias("pkg")
        )
        return _union(customers, suppliers)

    def _class_symbol(self, table: str, prefix: str, key: str, name: str, display: Column) -> DataFrame:
        return self.read(table).select(F.lit(CLASS).alias("kind"), _id(prefix, key).alias("dex_id"), _id(prefix, key).alias("cls_dex"), F.col(name).alias("name"), display.alias("display"))

    def _methods(self) -> DataFrame:
        orders = self.read("orders").select(
            _id("C", "o_custkey").alias("cls_dex"),
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"),
            F.col("o_orderpriority").alias("return_type"),
            (F.col("o_orderstatus") == "P").alias("constructor"),
        )
        supplied = self.read("lineitem").select("l_suppkey", "l_partkey").distinct()
        supplied = supplied.select(_id("S", "l_suppkey").alias("cls_dex"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.lit("void").alias("return_type"), F.lit(False).alias("constructor"))
        return _union(orders, supplied)

    @property
    def methods(self) -> DataFrame:
        key = F.concat("cls_dex", F.lit("->"), "name")
        return self._methods().select("cls_dex", key.alias("dex_id"), "name", F.concat("name", F.lit("()")).alias("descriptor"), "return_type", "constructor")

    @property
    def fields(self) -> DataFrame:
        owner = _id("B", "p_brand")
        return self.read("part").select(owner.alias("cls_dex"), F.concat(owner, F.lit("->P"), F.col("p_partkey").cast("string")).alias("dex_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))

    @property
    def symbols(self) -> DataFrame:
        named = lambda prefix, name: F.concat(F.lit(f"{prefix}."), F.col(name))
        segment = self.read("customer").select("c_mktsegment").distinct().select(F.lit(CLASS).alias("kind"), _id("I", "c_mktsegment").alias("dex_id"), _id("I", "c_mktsegment").alias("cls_dex"), F.col("c_mktsegment").alias("name"), named("seg", "c_mktsegment").alias("display"))
        methods = self._methods().select(F.lit(METHOD).alias("kind"), F.concat("cls_dex", F.lit("->"), "name").alias("dex_id"), "cls_dex", "name", F.concat("cls_dex", F.lit("."), "name").alias("display"))
        fields = self.read("part").select(
            F.lit(FIELD).alias("kind"),
            F.concat(_id("B", "p_brand"), F.lit("->P"), F.col("p_partkey").cast("string")).alias("dex_id"),
            _id("B", "p_brand").alias("cls_dex"),
            F.col("p_name").alias("name"),
            F.concat("p_brand", F.lit("."), "p_name").alias("display"),
        )
        return _union(
            self._class_symbol("customer", "C", "c_custkey", "c_name", F.concat(F.lit("cust."), "c_mktsegment", F.lit("."), "c_name")),
            self._class_symbol("supplier", "S", "s_suppkey", "s_name", named("supp", "s_name")),
            self._class_symbol("nation", "N", "n_nationkey", "n_name", named("geo", "n_name")),
            self._class_symbol("region", "R", "r_regionkey", "r_name", named("geo", "r_name")),
            segment,
            methods,
            fields,
        )

    @property
    def edges(self) -> DataFrame:
        orders, lines = self.read("orders").select("o_orderkey", "o_custkey"), self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        ordered = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        method = F.concat(_id("C", "o_custkey"), F.lit("->o"), F.col("o_orderkey").cast("string"))
        edge = lambda df, src, dst, type_: df.select(src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"))
        supplied = ordered.join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        parts = ordered.join(self.read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return _union(
            edge(ordered, method, F.concat(_id("S", "l_suppkey"), F.lit("->p"), F.col("l_partkey").cast("string")), CALLS),
            edge(self.read("customer"), _id("C", "c_custkey"), _id("N", "c_nationkey"), USES_CLASS),
            edge(self.read("supplier"), _id("S", "s_suppkey"), _id("N", "s_nationkey"), USES_CLASS),
            edge(supplied, method, _id("N", "s_nationkey"), USES_CLASS),
            edge(parts, method, F.concat(_id("B", "p_brand"), F.lit("->P"), F.col("p_partkey").cast("string")), USES_FIELD),
            edge(self.read("nation"), _id("N", "n_nationkey"), _id("R", "n_regionkey"), EXTENDS),
            edge(self.read("customer"), _id("C", "c_custkey"), _id("I", "c_mktsegment"), IMPLEMENTS),
        )

    @property
    def bodies(self) -> DataFrame:
        package = F.concat("lang", F.lit("."), "source")
        name = F.concat(package, F.lit(".D"), F.col("doc_id").cast("string"))
        return self.read("documents").select(F.col("doc_id").cast("long").alias("cls_idx"), name.alias("fqn"), package.alias("pkg"), F.col("text").alias("body"))

    @property
    def raw_bodies(self) -> DataFrame:
        """The other text of a class: pages' markup."""
        return self.read("pages").select(F.col("page_id").cast("long").alias("cls_idx"), F.col("url").alias("fqn"), F.lit(None).cast("string").alias("pkg"), F.col("html").alias("body"))

    @property
    def literals(self) -> DataFrame:
        return const_strings(self.raw_bodies)

    @property
    def resources(self) -> DataFrame:
        return self.read("pages").select(F.col("url").alias("name"), F.col("html").alias("content"))

    #: There is no stored index of these texts.
    postings = None

    @property
    def literal_classes(self) -> DataFrame:
        """The classes that literals belong to."""
        return self.raw_bodies

    @property
    def bodies_by_key(self) -> DataFrame:
        """Texts by a class' key: a customer's is the document of that number."""
        return self.bodies.withColumn("cls_dex", F.concat(F.lit("C/"), "cls_idx"))

    @property
    def renames(self) -> DataFrame:
        """A journal: some names typed, and one of each of the first orders."""
        rows = [(1, "CLASS", "C/1", None, "Alice"), (2, "CLASS", "C/2", None, "Bob"), (3, "CLASS", "C/1", None, "Alicia"), (4, "FIELD", "B/Brand#2", "P0", "ring"), (5, "PACKAGE", "cust", None, "buyer"), (6, "PACKAGE", "cust.BUILDING", None, "firm"), (7, "ODD", "C/3", None, "no")]
        orders = self.read("orders").where("o_orderkey < 5")
        order = F.col("o_orderkey").cast("string")
        named = orders.select((100 + F.col("o_orderkey")).cast("long").alias("seq"), F.lit("METHOD").alias("type"), _id("C", "o_custkey").alias("cls"), F.concat(F.lit("o"), order).alias("id"), F.concat(F.lit("settle"), order).alias("new_name"))
        return self.spark.createDataFrame(rows, RENAMES).unionByName(named)

    @property
    def string_files(self) -> DataFrame:
        """Resources, one for each brand with its parts as named strings, among others that aren't such files."""
        element = F.concat(F.lit('  <string translatable="false" name="p'), F.col("p_partkey").cast("string"), F.lit('">\n '), "p_name", F.lit(" &amp; "), "p_type", F.lit("\t</string>"))
        files = self.read("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(element)), "\n").alias("all"))  # a brand's file
        files = files.select(F.concat(F.lit("res/"), "p_brand", F.lit("/strings.xml")).alias("name"), F.concat(F.lit("<resources>\n"), "all", F.lit("\n</resources>")).alias("content"))
        return _union(files, files.select(F.concat("name", F.lit(".bak")).alias("name"), "content"), self.resources)

    @property
    def manifests(self) -> DataFrame:
        """A manifest of each supplier, in turn with a plain activity, an alias, none, a declared type, and a filter that isn't the activity's own."""
        key, turn = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
        starts = '<intent-filter><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></intent-filter>'
        head = F.concat(F.lit('<manifest xmlns:android="a" package="com.s'), key, F.lit('"><application>'))
        tail = F.lit("</application></manifest>")
        plain = F.concat(head, F.lit('<activity android:name=".Main'), key, F.lit(f'">{starts}</activity>'), tail)
        alias = F.concat(head, F.lit('<activity android:name="Other"/><activity-alias android:name="Alias'), key, F.lit(f'">{starts}</activity-alias>'), tail)
        none = F.concat(F.lit('<manifest package="com.s'), key, F.lit('"/>'))
        typed = F.concat(F.lit('<!DOCTYPE manifest [<!ENTITY e "x">]>'), head, tail)
        deep = F.concat(head, F.lit(f'<activity android:name="Deep"><wrapper>{starts}</wrapper></activity><activity android:name="com.y.Full"><intent-filter/>{starts}</activity>'), tail)
        content = F.when(turn == 0, plain).when(turn == 1, alias).when(turn == 2, none).when(turn == 3, typed).otherwise(deep)
        return self.read("supplier").select(F.concat(F.lit("supp"), key, F.lit("/AndroidManifest.xml")).alias("name"), content.alias("content"))

    @property
    def order_sources(self) -> DataFrame:
        """A class text for each order: a method with nested braces, one without a body and one that never ends."""
        key, turn = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
        before = F.concat(F.lit("class O {\n  int a() { return 1; }\n  int o"), key)
        nested = F.concat(before, F.lit("(int x) {\n    if (x > 0) { return 1; }\n    return 0;\n  }\n  void z() {}\n}"))
        declared = F.concat(before, F.lit("(int x);\n"))
        endless = F.concat(before, F.lit("(int x) { { }\n"), F.lit("y" * 500))
        other = F.lit("class O {}")
        source = F.when(turn == 0, nested).when(turn == 1, declared).when(turn == 2, endless).otherwise(other)
        return self.read("orders").select("o_orderkey", F.concat(F.lit("o"), key).alias("name"), source.alias("source"))
