"""Rules that the registered queries don't reach."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ashlar.functions import strings
from ashlar.operators import catalog, extract, graph, overlay, paging, text
from ashlar.plans import registry
from ashlar.schema import BODIES, CLASSES, EDGES, METHODS, RENAMES, RESOURCES, SYMBOLS
from ashlar.session import Session
from ashlar.sources import journal
from ashlar.streaming.build import Index

FOLDER = "/root/testdata/sf0.001"


def scan_literals(code: str) -> list[str]:
    """Literals by a plain scanner."""
    out, at = [], 0
    while (at := code.find('"', at)) >= 0:
        made, at = [], at + 1
        while at < len(code) and code[at] != '"' and code[at] != "\n":
            if code[at] == "\\":
                if at + 1 >= len(code):
                    at = len(code)
                    break
                made.append(code[at : at + 2])
                at += 2
            else:
                made.append(code[at])
                at += 1
        if at < len(code) and code[at] == '"':
            out.append("".join(made))
            at += 1
    return list(dict.fromkeys(s for s in out if 1 <= len(s) <= 512))


def test_literals_equal_a_scanner(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet='ab"\\\n ', max_size=40), min_size=200, max_size=200))
    def check(codes):
        rows = spark.createDataFrame(list(enumerate(codes)), "i int, code string").select("i", strings.literals(F.col("code")).alias("found")).collect()
        assert {r.i: r.found for r in rows} == {i: scan_literals(c) for i, c in enumerate(codes)}

    check()
    long = '"' + "x" * 513 + '"' + '"' + "\\n" * 200 + '"' + '"' + "y" * 200_000 + '"'
    (found,) = spark.createDataFrame([(long,)], "code string").select(strings.literals(F.col("code"))).first()
    assert found == ["\\n" * 200]


def test_like_is_ascii_only_and_keeps_backslashes(spark):
    df = spark.createDataFrame([("ABC",), ("a\\c",), ("É",), ("é",), ("axc",), (None,)], "s string")
    holds = lambda value: [r.s for r in df.where(strings.like_contains(F.col("s"), value)).collect()]
    assert holds("bC") == ["ABC"]
    assert holds("\\") == ["a\\c"]
    assert holds("é") == ["é"]
    assert holds("a_c") == ["ABC", "a\\c", "axc"]


@pytest.mark.parametrize(("term", "regex", "engine"), [("", False, "none"), ("ab", False, "scan"), ("abc", False, "index"), ("abc", True, "scan"), ("f(x", False, "scan"), ("a\n(b", False, "index"), ("😀😀", False, "scan"), ("😀😀😀", False, "index")])
def test_router(term, regex, engine):
    assert text.engine_for(term, regex) == engine


def bodies(spark, *rows):
    return spark.createDataFrame(list(rows), BODIES)


def test_search_code(spark):
    df = bodies(spark, (1, "p.A", "p", "onCreate()\nx\nonCreate()\n foo(1)\n foo(2)\n foo(3)\n foo(4)"), (2, None, None, "ÉCOLE " + "z" * 300), (3, "p.C", "p", None), (4, "p.D", "p", ""))
    assert [tuple(r) for r in text.search_code(df, "ONCREATE").collect()] == [("substring", "p.A", 1, None)]
    assert [r["class"] for r in text.search_code(df, "école").collect()] == ["#2"]
    assert text.search_code(df, "ecole").collect() == []
    assert [r.snippet for r in text.search_code(df, "foo(").collect()] == ["foo(1)", "foo(2)", "foo(3)"]
    assert [r.snippet for r in text.search_code(df, "onCreate(", limit=1).collect()] == ["onCreate()"]  # equal lines once
    assert text.search_code(df, "FOO(").collect() == []
    (long,) = text.search_code(df, "z{300}", True).collect()
    assert len(long.snippet) == 241 and long.snippet.endswith("…")
    assert text.search_code(df, "").collect() == []
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        text.search_code(df, "(", True)
    assert text.capped_note(100, 100) == "capped at limit" and text.capped_note(99, 100) is None


def test_postings_give_the_same_as_a_scan(spark):
    df = bodies(spark, (1, "a", "", "The quick\nbrown"), (2, "b", "", "the quacks"), (3, "c", "", "th"), (4, "d", "", None))
    index = text.postings(df)
    for term in ("the qu", "k\nb", "quick", "zzz"):
        assert text.search_by_index(df, index, term).collect() == text.search_bodies(df, term).collect()


def test_paging(spark):
    df = spark.range(5)
    rows = paging.page(df, "id", offset="3", limit=10).collect()
    assert [(r.id, r.total, r.offset, r.limit, r.returned, r.has_more) for r in rows] == [(3, 5, 3, 10, 2, False), (4, 5, 3, 10, 2, False)]
    assert paging.page(df, "id", offset=99).collect() == []
    assert [r.has_more for r in paging.page(df, "id", limit=0).collect()] == [True]  # a limit is at least 1
    assert [paging.int_arg(v, 200, 1, 2000) for v in ("7", None, "x", 0, 9999)] == [7, 200, 200, 1, 2000]


def small_graph(spark):
    classes = spark.createDataFrame([(1, "A", "p.A", "p"), (2, "B", "p.B", None)], CLASSES)
    symbols = spark.createDataFrame([(0, "A", "A", "A", "p.A"), (0, "B", "B", "B", "p.B"), (1, "A->m", "A", "m", "A.m"), (1, "B->n", "B", "n", "B.n"), (1, "X->q", "X", "q", None)], SYMBOLS)
    edges = spark.createDataFrame([("A->m", "B->n", 0), ("A->m", "B->n", 0), ("A->m", "A->m", 0), ("A->m", "X->q", 0), ("A", "A", 1), ("A", "A", 1), ("X->q", "A", 1), ("B", "A", 3)], EDGES)
    return classes, symbols, edges


def test_graph_is_a_multigraph(spark):
    classes, symbols, edges = small_graph(spark)
    assert sorted(r["class"] for r in graph.class_users(classes, symbols, edges, "A").collect()) == ["X", "p.A"]  # itself too
    assert [r.name for r in graph.incoming(symbols, edges, 0, "B->n").collect()] == ["m", "m"]
    assert sorted(r["class"] for r in graph.call_graph(classes, symbols, edges, "A").collect()) == ["X", "p.B"]
    assert [tuple(r) for r in graph.subtypes(symbols, edges, "A").collect()] == [("p.B", "extends")]
    assert graph.subtypes(symbols, edges, "unknown").collect() == []


def test_unknown_names(spark):
    classes, _, _ = small_graph(spark)
    assert catalog.resolve_class(classes, "p.A").first().dex_id == "A" == catalog.resolve_class(classes, "A").first().dex_id
    with pytest.raises(catalog.NotFound):
        catalog.key_of(classes, "p.Z")
    assert {(r.package, r.classes) for r in catalog.package_tree(classes).collect()} == {("", 1), ("p", 1)}


def test_renames(spark, tmp_path):
    classes, _, _ = small_graph(spark)
    log = spark.createDataFrame([(1, "CLASS", "A", None, "One"), (2, "CLASS", "A", None, "Two"), (3, "PACKAGE", "p", None, "q.r"), (4, "ODD", "A", None, "no")], RENAMES)
    assert {r.dex_id: (r.fqn, r.pkg) for r in overlay.renamed_classes(classes, log).collect()} == {"A": ("q.r.Two", "q.r"), "B": ("p.B", None)}
    entry = overlay.rename_class(classes, log, "p.B", "a\tb")
    assert [tuple(r) for r in entry.collect()] == [(5, "CLASS", "B", None, "a b")]
    journal.write_journal(log.unionByName(entry), str(tmp_path / "j"))
    back = journal.read_journal(spark, str(tmp_path / "j")).orderBy("seq").collect()
    assert [(r.type, r.cls, r.id, r.new_name) for r in back][-1] == ("CLASS", "B", None, "a b") and len(back) == 5


def test_ambiguous_method(spark):
    classes, _, _ = small_graph(spark)
    methods = spark.createDataFrame([("A", "A->f1", "f", "f(I)", "V", False), ("A", "A->f2", "f", "f(J)", "V", False)], "cls_dex string, dex_id string, name string, descriptor string, return_type string, constructor boolean")
    empty = spark.createDataFrame([], RENAMES)
    with pytest.raises(overlay.Ambiguous) as e:
        overlay.rename_method(classes, methods, empty, "p.A", "f(x)", "g")
    assert e.value.descriptors == ["f(I)", "f(J)"]
    (row,) = overlay.rename_method(classes, methods, empty, "p.A", "f", "g", "f(J)").collect()
    assert tuple(row) == (1, "METHOD", "A", "f2", "g")  # the rest of its key
    with pytest.raises(catalog.NotFound):
        overlay.rename_method(classes, methods, empty, "p.A", "zz", "g")


def test_method_slice():
    code = "x\n  void f(int a) { if (a) { b(); } }\n  void g();"
    assert extract.slice_method(code, "f") == "  void f(int a) { if (a) { b(); } }"
    assert extract.slice_method(code, "g") == "  void g();"
    assert extract.slice_method("a f( { {", "f") == "a f( { {"
    assert extract.slice_method(code, "zz") is None and extract.slice_method(None, "f") is None


def test_string_resources(spark):
    df = spark.createDataFrame([("res/strings.xml", '<string name="a">\n x &amp; </string><string translatable="no" name="b">y</string>'), ("other.xml", '<string name="c">z</string>')], "name string, content string")
    assert [(r.name, r.value) for r in extract.string_resources(df).orderBy("pos").collect()] == [("a", "x &amp;"), ("b", "y")]


def test_registry(spark):
    assert len(registry.OPERATORS) == 32
    session = Session(spark)
    assert registry.call(session, "current_apk").first().loaded is False
    assert registry.answer(session, "index_status")["is_error"]
    assert registry.call(session, "load_apk", {"path": FOLDER}).first().classes == 160
    assert registry.answer(session, "get_class_source")["error"] == "get_class_source needs class_name"
    assert registry.answer(session, "get_xrefs_to_class", {"class_name": "C/none"})["is_error"]
    calls = {
        "current_apk": {}, "index_status": {}, "get_all_classes": {"limit": 3}, "get_package_tree": {}, "get_methods_of_class": {"class_name": "C/1"}, "get_fields_of_class": {"class_name": "B/Brand#1"},
        "get_class_source": {"class_name": "fr.src2.D2"}, "search_string_constants": {"query": "the"}, "find_string_usages": {"value": "en"}, "get_xrefs_to_class": {"class_name": "N/7"},
        "get_xrefs_to_field": {"class_name": "B/Brand#1", "field_name": "blue anvil"}, "get_xrefs_from_class": {"class_name": "C/1"}, "get_call_graph": {"class_name": "C/1"}, "get_subclasses": {"class_name": "R/0"},
        "get_android_manifest": {}, "list_resource_files": {"limit": 2}, "search_in_code": {"query": "the"}, "search_classes_by_keyword": {"keyword": "cust"}, "search_method_by_name": {"method_name": "o1"},
    }
    for name, args in calls.items():
        out = registry.answer(session, name, args)
        assert "error" not in out, (name, out)
    for name, args in {"get_fields_of_class": {"class_name": "none"}, "get_class_source": {"class_name": "none"}, "get_smali_of_class": {"class_name": "none"}, "get_resource_file": {"name": "none"}}.items():
        assert "not found" in registry.answer(session, name, args)["error"]
    assert registry.answer(session, "search_in_code", {"query": "the", "limit": 2})["note"] == "capped at limit"
    assert registry.call(session, "clear_cache").first().result == "cleared"


def test_renames_show_in_every_operator(spark):
    session = Session(spark)
    session.load(FOLDER)
    ask = lambda name, **a: registry.answer(session, name, a)["rows"]
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderkey = 0").first()
    owner = f"C/{orders.o_custkey}"
    line = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_orderkey = 0").first()
    for name, args in {
        "rename_class": {"class_name": owner, "new_name": "Zed"},
        "rename_method": {"class_name": owner, "method_name": "o0(int)", "new_name": "settleAll"},
        "rename_field": {"class_name": "B/Brand#1", "field_name": "blue anvil", "new_name": "gear"},
        "rename_package": {"old_name": "cust", "new_name": "buyer.far"},
    }.items():
        assert ask(name, **args) == [{"result": "renamed"}]
    (zed,) = ask("search_classes_by_keyword", keyword="zed")
    assert zed["class"].startswith("buyer.far.") and zed["class"].endswith(".Zed")
    assert [r["name"] for r in ask("get_methods_of_class", class_name=zed["class"]) if r["descriptor"] == "o0()"] == ["settleAll"]
    assert [(r["class"], r["method"]) for r in ask("search_method_by_name", method_name="SETTLEALL")] == [(zed["class"], "settleAll")]
    assert len(ask("get_xrefs_from_method", class_name=zed["class"], method_name="settleAll")) > 0
    callers = ask("get_xrefs_to_method", class_name=f"S/{line.l_suppkey}", method_name=f"p{line.l_partkey}", limit=2000)
    assert f"{owner}.settleAll" in {r["display"] for r in callers}
    assert "gear" in {r["name"] for r in ask("get_fields_of_class", class_name="B/Brand#1")}
    assert ask("get_xrefs_to_field", class_name="B/Brand#1", field_name="gear")
    assert {r["package"] for r in ask("get_package_tree")} == {"supp"} | {p for r in ask("get_all_classes", limit=2000) if (p := r["class"].rpartition(".")[0]).startswith("buyer.far.")}
    assert any(r["class"].startswith("buyer.far.") for r in ask("get_xrefs_to_class", class_name="N/7"))
    # a package that has been moved goes by its present name; a text's class shows it
    assert ask("rename_package", old_name="buyer.far", new_name="near")
    assert ask("get_all_classes", limit=1)[0]["class"].startswith("near.")
    ask("rename_package", old_name="fr", new_name="gaul")
    assert ask("get_class_source", class_name="gaul.src2.D2") and any(r["class"].startswith("gaul.") for r in ask("search_in_code", query="pour", limit=1000))


def test_a_stored_index_is_a_corpus(spark, tmp_path):
    classes, symbols, edges = small_graph(spark)
    index = Index(spark, str(tmp_path / "index"))
    index.write("classes", classes.unionByName(classes))
    index.write_graph(symbols, edges)
    index.write("methods", spark.createDataFrame([("A", "A->m", "m", "m()", "V", False)], METHODS))
    index.write("resources", spark.createDataFrame([("x/strings.xml", '<string name="a">b</string>')], RESOURCES))
    session = Session(spark)
    assert session.load(index.folder).first()["index"] == "BUILDING"
    ask = lambda name, **a: registry.answer(session, name, a)
    assert "BUILDING" in ask("get_xrefs_to_class", class_name="p.A")["index_note"]
    (row,) = ask("index_status")["rows"]
    assert (row["state"], row["percent"], row["total_classes"], row["edges"]) == ("BUILDING", 0, 2, 8)
    texts = str(tmp_path / "texts")
    bodies(spark, (1, "p.A", "p", 'void m() { call("lit"); }'), (2, "p.B", None, "nothing here")).write.parquet(texts)
    index.write_texts(texts, BODIES, main_package="p")
    session.load(index.folder)
    found = ask("search_in_code", query="nothing he")
    assert [(r["engine"], r["class"]) for r in found["rows"]] == [("index", "p.B")] and "index_note" not in found
    assert ask("search_in_code", query="absent")["rows"] == []
    assert [r["code"] for r in ask("get_method_by_name", class_name="p.A", method_name="m")["rows"]] == ['void m() { call("lit"); }']
    assert ask("search_string_constants", query="LIT")["rows"] == [{"string": "lit", "class": "p.A"}]
    assert ask("get_strings")["rows"][0]["value"] == "b"
    assert ask("index_status")["rows"][0]["percent"] == 100
    ask("rename_class", class_name="p.A", new_name="Z")
    again = Session(spark)
    again.load(index.folder)  # the journal is replayed
    assert [r["class"] for r in registry.answer(again, "search_in_code", {"query": "void"})["rows"]] == ["p.Z"]
    assert registry.answer(again, "get_class_source", {"class_name": "p.Z"})["rows"][0]["source"].startswith("void")
    assert "no text" in registry.answer(again, "get_smali_of_class", {"class_name": "p.Z"})["error"]


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 'a"\n')], "i int, n string, s string")
    assert journal.to_json(df).first().json == '{"i":1,"n":null,"s":"a\\"\\n"}'


def test_texts_by_path(spark, tmp_path):
    (tmp_path / "0a").mkdir()
    (tmp_path / "0a" / "0000000a.java").write_text("class A {}\n// x")
    classes = spark.createDataFrame([(10, "A", "p.A", "p")], CLASSES)
    (row,) = journal.named_by_path(journal.read_texts(spark, str(tmp_path)), classes).collect()
    assert (row.cls_idx, row.fqn, row.body) == (10, "p.A", "class A {}\n// x")


def test_no_pattern_is_shared_with_user_input():
    assert re.compile(strings.STRING_RESOURCE).groups == 2
