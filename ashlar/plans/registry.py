"""The engine's 32 named operators: argument names, defaults and what they call.

``call(session, name, args)`` gives a DataFrame, or raises; it runs nothing but
look-ups by name. ``answer`` turns that into the envelope for a caller outside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, extract, graph, overlay, text
from ..operators.paging import page
from ..schema import RENAMES
from ..session import Session
from ..streaming.build import READY, status_row

REQUIRED = object()
PAGED = {"offset": 0, "limit": 200}


@dataclass(frozen=True)
class Operator:
    about: str
    run: Callable[[Session, dict], DataFrame]
    args: dict = field(default_factory=dict)


def _flag(value: object) -> bool:
    return value is True or str(value).lower() == "true"


def _record(s: Session, entry: DataFrame) -> DataFrame:
    """Append to the journal: the index' own, or else the session's. It's small: what people typed."""
    if s.index:
        s.index.record(entry)
        s.journal = s.current().renames
    else:
        s.journal = _journal(s).unionByName(s.spark.createDataFrame(entry.collect(), RENAMES))
    return s.spark.createDataFrame([("renamed",)], "result string")


def _journal(s: Session) -> DataFrame:
    return s.spark.createDataFrame([], RENAMES) if s.journal is None else s.journal


def _now(s: Session, table: str) -> DataFrame:
    """A table of the corpus under current names; without renames, as it is."""
    t = s.current()
    df = getattr(t, table)
    if s.journal is None:
        return df
    if table == "classes":
        return overlay.renamed_classes(df, s.journal)
    if table == "symbols":
        return overlay.renamed_symbols(df, s.journal, t.classes)
    if table in ("methods", "fields"):
        return overlay.renamed_members(df, s.journal)
    return overlay.renamed_bodies(df, t.classes, s.journal)


def _key(s: Session, name: str) -> str:
    return catalog.key_of(_now(s, "classes"), name)


def _graph_key(s: Session, name: str) -> str:
    """A class' key: of a class with a row, or of one that is only a symbol or has only members."""
    try:
        return _key(s, name)
    except catalog.NotFound:
        t = s.current()
        if catalog.exists(t.symbols.where((F.col("dex_id") == name) | (F.col("cls_dex") == name))):
            return name
        raise


def _status(s: Session) -> DataFrame:
    """Of an index, its own account; of tables without one, their counts, which are all there is."""
    t = s.current()
    if s.index:
        return s.index.status(t.classes.count())
    row = status_row(t.classes, t.classes, t.symbols, t.edges, t.literals)
    return row.withColumns({"state": F.lit(s.state()), "ready": F.lit(True), "coverage_complete": F.lit(True)})


def _resource(s: Session, name: str) -> DataFrame:
    found = catalog.resource(s.current().resources, name)
    if not catalog.exists(found):
        raise catalog.NotFound(f"resource not found: {name}")
    return found


def _methods_by_name(s: Session, a: dict) -> DataFrame:
    found = extract.methods_by_name(_now(s, "methods"), s.current().bodies_by_key, _key(s, a["class_name"]), a["method_name"], a["descriptor"])
    if not catalog.exists(found.select("name")):
        raise catalog.NotFound(f"method not found: {a['method_name']}")
    return found


def _manifest(s: Session) -> DataFrame:
    found = catalog.resource(s.current().resources, "AndroidManifest.xml")
    one = s.spark.range(1).join(found.select("content"), F.lit(True), "left")
    return one.select(F.coalesce("content", F.lit("manifest not found")).alias("content"))


CLASS_ARG, METHOD_ARGS = {"class_name": REQUIRED}, {"class_name": REQUIRED, "method_name": REQUIRED, "descriptor": None}

OPERATORS: dict[str, Operator] = {
    # session
    "load_apk": Operator("Load a corpus.", lambda s, a: s.load(a["path"], _flag(a["deobf"])), {"path": REQUIRED, "deobf": False}),
    "current_apk": Operator("What is loaded.", lambda s, a: s.info()),
    "index_status": Operator("Counts of the index.", lambda s, a: _status(s)),
    "clear_cache": Operator("Drop cached tables.", lambda s, a: (s.clear_cache(), s.spark.createDataFrame([("cleared",)], "result string"))[1]),
    # enumeration
    "get_all_classes": Operator("Names of all classes.", lambda s, a: page(_now(s, "classes").select(F.col("fqn").alias("class"), "cls_idx"), "cls_idx", **a).drop("cls_idx"), PAGED),
    "get_package_tree": Operator("Classes by package.", lambda s, a: page(catalog.package_tree(_now(s, "classes")), "package", **a), PAGED),
    "get_methods_of_class": Operator("Methods of a class.", lambda s, a: catalog.methods_of_class(_now(s, "methods"), _key(s, a["class_name"])), CLASS_ARG),
    "get_fields_of_class": Operator("Fields of a class.", lambda s, a: catalog.fields_of_class(_now(s, "fields"), _graph_key(s, a["class_name"])), CLASS_ARG),
    # class texts
    "get_class_source": Operator("A class' text.", lambda s, a: catalog.text_of(_now(s, "classes"), _now(s, "bodies"), a["class_name"]), CLASS_ARG),
    "get_smali_of_class": Operator("A class' other text.", lambda s, a: catalog.text_of(_now(s, "classes"), _now(s, "raw_bodies"), a["class_name"]), CLASS_ARG),
    "get_method_by_name": Operator("Methods by name, with code.", _methods_by_name, METHOD_ARGS),
    # strings
    "search_string_constants": Operator("Literals that hold a term.", lambda s, a: text.search_strings(s.current().literals, _now(s, "literal_classes"), a["query"], a["limit"]), {"query": REQUIRED, "limit": 200}),
    "find_string_usages": Operator("Classes that use a literal.", lambda s, a: text.string_usages(s.current().literals, _now(s, "literal_classes"), a["value"], _flag(a["contains"]), a["limit"]), {"value": REQUIRED, "contains": False, "limit": 200}),
    "get_strings": Operator("Named strings of resources.", lambda s, a: page(extract.string_resources(s.current().resources), "resource", "pos", **a), PAGED),
    # references
    "get_xrefs_to_class": Operator("Classes that use a class.", lambda s, a: page(graph.class_users(_now(s, "classes"), _now(s, "symbols"), s.current().edges, _graph_key(s, a.pop("class_name"))), "class", **a), CLASS_ARG | PAGED),
    "get_xrefs_to_method": Operator("Callers of a method.", lambda s, a: _method_refs(graph.xrefs_to_method, s, a), METHOD_ARGS | PAGED),
    "get_xrefs_from_method": Operator("Callees of a method.", lambda s, a: _method_refs(graph.xrefs_from_method, s, a), METHOD_ARGS | PAGED),
    "get_xrefs_to_field": Operator("Users of a field.", lambda s, a: page(graph.xrefs_to_field(_now(s, "fields"), _now(s, "symbols"), s.current().edges, _graph_key(s, a.pop("class_name")), a.pop("field_name")), "class", "display", **a), {"class_name": REQUIRED, "field_name": REQUIRED} | PAGED),
    "get_xrefs_from_class": Operator("Classes a class calls.", lambda s, a: _calls(s, a), CLASS_ARG | PAGED),
    "get_call_graph": Operator("The same: one step.", lambda s, a: _calls(s, a), CLASS_ARG | PAGED),
    "get_subclasses": Operator("Direct subtypes.", lambda s, a: page(graph.subtypes(_now(s, "symbols"), s.current().edges, a.pop("class_name")), "class", "relation", **a), CLASS_ARG | PAGED),
    # resources
    "get_android_manifest": Operator("The manifest.", lambda s, a: _manifest(s)),
    "get_main_activity": Operator("What a launcher starts.", lambda s, a: extract.launcher(s.current().resources.where("name = 'AndroidManifest.xml'"))),
    "list_resource_files": Operator("Names of resources.", lambda s, a: page(s.current().resources.select("name"), "name", **a), PAGED),
    "get_resource_file": Operator("A resource's text.", lambda s, a: _resource(s, a["name"]), {"name": REQUIRED}),
    # renaming
    "rename_class": Operator("Rename a class.", lambda s, a: _record(s, overlay.rename_class(_now(s, "classes"), _journal(s), a["class_name"], a["new_name"])), CLASS_ARG | {"new_name": REQUIRED}),
    "rename_method": Operator("Rename a method.", lambda s, a: _record(s, overlay.rename_method(_now(s, "classes"), _now(s, "methods"), _journal(s), a["class_name"], a["method_name"], a["new_name"], a["descriptor"])), METHOD_ARGS | {"new_name": REQUIRED}),
    "rename_field": Operator("Rename a field.", lambda s, a: _record(s, overlay.rename_field(_now(s, "classes"), _now(s, "fields"), _journal(s), a["class_name"], a["field_name"], a["new_name"], _graph_key(s, a["class_name"]))), CLASS_ARG | {"field_name": REQUIRED, "new_name": REQUIRED}),
    "rename_package": Operator("Rename a package.", lambda s, a: _record(s, overlay.rename_package(_journal(s), a["old_name"], a["new_name"])), {"old_name": REQUIRED, "new_name": REQUIRED}),
    # search
    "search_in_code": Operator("Search class texts.", lambda s, a: text.search_code(_now(s, "bodies"), a["query"], _flag(a["regex"]), a["limit"], s.current().postings), {"query": REQUIRED, "regex": False, "limit": 100}),
    "search_classes_by_keyword": Operator("Class names that hold a word.", lambda s, a: catalog.search_classes(_now(s, "classes"), a["keyword"], a["limit"]), {"keyword": REQUIRED, "limit": 200}),
    "search_method_by_name": Operator("Methods whose name holds a word.", lambda s, a: catalog.search_methods(_now(s, "classes"), _now(s, "methods"), a["method_name"], a["limit"]), {"method_name": REQUIRED, "limit": 200}),
}


def _method_refs(find: Callable, s: Session, a: dict) -> DataFrame:
    found = find(_now(s, "methods"), _now(s, "symbols"), s.current().edges, _key(s, a.pop("class_name")), a.pop("method_name"), a.pop("descriptor"))
    return page(found, "class", "display", **a)


def _calls(s: Session, a: dict) -> DataFrame:
    key = _key(s, a.pop("class_name"))
    return page(graph.call_graph(_now(s, "classes"), s.current().symbols, s.current().edges, key), "class", **a)


#: Operators whose answers may lack something while an index is being built, and those with a limit that a note tells of.
NOTED = {"search_string_constants", "find_string_usages", "search_in_code", "search_classes_by_keyword", "search_method_by_name"} | {n for n in OPERATORS if n.startswith("get_xrefs_") or n in ("get_call_graph", "get_subclasses", "get_package_tree")}
CAPPED = {"search_in_code": (100, 1000)}


def call(session: Session, name: str, args: dict | None = None) -> DataFrame:
    """Run an operator; a missing or unknown argument is an error."""
    operator = OPERATORS[name]
    given = dict(args or {})
    if unknown := set(given) - set(operator.args):
        raise TypeError(f"{name} has no argument {', '.join(sorted(unknown))}")
    values = {k: given.get(k, default) for k, default in operator.args.items()}
    if missing := [k for k, v in values.items() if v is REQUIRED or v is None and operator.args[k] is REQUIRED]:
        raise TypeError(f"{name} needs {', '.join(missing)}")
    return operator.run(session, values)


def answer(session: Session, name: str, args: dict | None = None) -> dict:
    """Rows for a caller outside, or the error and the operator's name."""
    try:
        rows = [r.asDict(recursive=True) for r in call(session, name, args).collect()]
    except overlay.Ambiguous as e:
        return {"error": str(e), "descriptors": e.descriptors}
    except Exception as e:  # noqa: BLE001  whatever went wrong is the caller's answer
        return {"error": str(e), "tool": name, "is_error": True}
    out = {"rows": rows, "count": len(rows)}
    if name in CAPPED and (note := text.capped_note(len(rows), (args or {}).get("limit"), *CAPPED[name])):
        out["note"] = note
    if name in NOTED and (state := session.state()) != READY:
        out["index_note"] = f"the index is {state}; results may be partial, see index_status"
    return out
