"""The fixed schemas of the code-knowledge tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 1

#: Kinds of symbols and types of references, as stored.
CLASS, METHOD, FIELD = 0, 1, 2
CALLS, USES_CLASS, USES_FIELD, EXTENDS, IMPLEMENTS = 0, 1, 2, 3, 4
KIND_NAMES = {CLASS: "class", METHOD: "method", FIELD: "field"}
RELATION_NAMES = {EXTENDS: "extends", IMPLEMENTS: "implements"}


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


META = _struct(k=StringType, v=StringType, seq=LongType)
CLASSES = _struct(cls_idx=LongType, dex_id=StringType, fqn=StringType, pkg=StringType)
SYMBOLS = _struct(kind=IntegerType, dex_id=StringType, cls_dex=StringType, name=StringType, display=StringType)
EDGES = _struct(src=StringType, dst=StringType, type=IntegerType)
METHODS = _struct(cls_dex=StringType, dex_id=StringType, name=StringType, descriptor=StringType, return_type=StringType, constructor=BooleanType)
FIELDS = _struct(cls_dex=StringType, dex_id=StringType, name=StringType, type=StringType)
BODIES = _struct(cls_idx=LongType, fqn=StringType, pkg=StringType, body=StringType)
POSTINGS = _struct(gram=StringType, cls_idx=LongType)
LITERALS = _struct(str=StringType, cls_idx=LongType)
RESOURCES = _struct(name=StringType, content=StringType)
RENAMES = _struct(seq=LongType, type=StringType, cls=StringType, id=StringType, new_name=StringType)
