"""The registered queries of the code-knowledge operators, each with its SQL twin for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import catalog, extract, graph, overlay, text
from ..operators.paging import page
from ..schema import CALLS, USES_CLASS
from ..sources.journal import to_json
from ..sources.stored import shared_folder
from ..sources.views import Tables
from ..streaming.build import status_row, write_postings

Query = Callable[[Tables], DataFrame]

_POSTINGS: dict[tuple[str, str], str] = {}


def stored_postings(t: Tables) -> DataFrame:
    """The postings of a folder's texts, written once a session, as a build writes them, and read from then on."""
    key = t.spark.sparkContext.applicationId, t.folder
    if key not in _POSTINGS:
        where = f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex[:12]}"
        write_postings(t.bodies, where)
        _POSTINGS[key] = where
    return t.spark.read.parquet(_POSTINGS[key])

_VIEWS = {
    "v_classes": """SELECT c_custkey AS cls_idx, 'C/' || c_custkey AS dex_id, 'cust.' || c_mktsegment || '.' || c_name AS fqn, 'cust.' || c_mktsegment AS pkg FROM customer
  UNION ALL SELECT 1000000000 + s_suppkey, 'S/' || s_suppkey, 'supp.' || s_name, 'supp' FROM supplier""",
    "v_methods": """SELECT 'C/' || o_custkey AS cls_dex, 'o' || o_orderkey AS name, o_orderpriority AS return_type, o_orderstatus = 'P' AS constructor FROM orders
  UNION ALL SELECT DISTINCT 'S/' || l_suppkey, 'p' || l_partkey, 'void', false FROM lineitem""",
    "v_fields": "SELECT 'B/' || p_brand AS cls_dex, 'B/' || p_brand || '->P' || p_partkey AS dex_id, p_name AS name, p_type AS type FROM part",
    "v_symbols": """SELECT 0 AS kind, 'C/' || c_custkey AS dex_id, 'C/' || c_custkey AS cls_dex, c_name AS name, 'cust.' || c_mktsegment || '.' || c_name AS display FROM customer
  UNION ALL SELECT 0, 'S/' || s_suppkey, 'S/' || s_suppkey, s_name, 'supp.' || s_name FROM supplier
  UNION ALL SELECT 0, 'N/' || n_nationkey, 'N/' || n_nationkey, n_name, 'geo.' || n_name FROM nation
  UNION ALL SELECT 0, 'R/' || r_regionkey, 'R/' || r_regionkey, r_name, 'geo.' || r_name FROM region
  UNION ALL SELECT DISTINCT 0, 'I/' || c_mktsegment, 'I/' || c_mktsegment, c_mktsegment, 'seg.' || c_mktsegment FROM customer
  UNION ALL SELECT 1, cls_dex || '->' || name, cls_dex, name, cls_dex || '.' || name FROM v_methods
  UNION ALL SELECT 2, 'B/' || p_brand || '->P' || p_partkey, 'B/' || p_brand, p_name, p_brand || '.' || p_name FROM part""",
    "v_edges": """SELECT 'C/' || o_custkey || '->o' || o_orderkey AS src, 'S/' || l_suppkey || '->p' || l_partkey AS dst, 0 AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'C/' || c_custkey, 'N/' || c_nationkey, 1 FROM customer
  UNION ALL SELECT 'S/' || s_suppkey, 'N/' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'C/' || o_custkey || '->o' || o_orderkey, 'N/' || s_nationkey, 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT 'C/' || o_custkey || '->o' || o_orderkey, 'B/' || p_brand || '->P' || p_partkey, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT 'N/' || n_nationkey, 'R/' || n_regionkey, 3 FROM nation
  UNION ALL SELECT 'C/' || c_custkey, 'I/' || c_mktsegment, 4 FROM customer""",
    "v_bodies": "SELECT doc_id AS cls_idx, lang || '.' || source || '.D' || doc_id AS fqn, lang || '.' || source AS pkg, text AS body FROM documents",
    "v_literals": r"""SELECT DISTINCT str, cls_idx FROM (SELECT page_id AS cls_idx, unnest(regexp_extract_all(html, '"([^"\\\n]*(?:\\[\s\S][^"\\\n]*)*)"', 1)) AS str FROM pages) WHERE length(str) BETWEEN 1 AND 512""",
    "v_resources": "SELECT url AS name, html AS content FROM pages",
    "v_renames": """SELECT * FROM (VALUES (1, 'CLASS', 'C/1', NULL, 'Alice'), (2, 'CLASS', 'C/2', NULL, 'Bob'), (3, 'CLASS', 'C/1', NULL, 'Alicia'), (4, 'FIELD', 'B/Brand#2', 'P0', 'ring'), (5, 'PACKAGE', 'cust', NULL, 'buyer'), (6, 'PACKAGE', 'cust.BUILDING', NULL, 'firm'), (7, 'ODD', 'C/3', NULL, 'no')) AS t(seq, type, cls, id, new_name)
  UNION ALL SELECT 100 + o_orderkey, 'METHOD', 'C/' || o_custkey, 'o' || o_orderkey, 'settle' || o_orderkey FROM orders WHERE o_orderkey < 5""",
    "v_now": """SELECT c.*, r.own, CASE WHEN pkg = 'cust.BUILDING' THEN 'firm' WHEN pkg LIKE 'cust.%' THEN 'buyer' || substr(pkg, 5) ELSE pkg END AS now
  FROM v_classes c LEFT JOIN (SELECT cls, arg_max(new_name, seq) AS own FROM v_renames WHERE type = 'CLASS' GROUP BY cls) r ON r.cls = c.dex_id""",
}


def _sql(body: str) -> str:
    """The statement with the views it names."""
    need, queue = [], [body]
    while queue:
        some = queue.pop()
        for name, definition in _VIEWS.items():
            if name in some and name not in need:
                need.append(name)
                queue.append(definition)
    with_ = ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in _VIEWS if name in need)
    return f"WITH {with_}\n{body}" if with_ else body


_MEMBER = "CASE s.kind WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'field' END AS kind, s.name, s.display, s.cls_dex AS class"
_USERS = """SELECT coalesce(fqn, cls_dex) AS class FROM (SELECT DISTINCT s.cls_dex, c.fqn FROM v_edges e JOIN v_symbols s ON e.src = s.dex_id LEFT JOIN v_classes c ON c.dex_id = s.cls_dex
WHERE e.type = 1 AND e.dst = '{}')"""
_CALLED = """SELECT coalesce(fqn, cls_dex) AS class FROM (SELECT DISTINCT d.cls_dex, c.fqn FROM v_edges e JOIN v_symbols s ON e.src = s.dex_id JOIN v_symbols d ON e.dst = d.dex_id
LEFT JOIN v_classes c ON c.dex_id = d.cls_dex WHERE e.type = 0 AND s.cls_dex = '{0}' AND d.cls_dex <> '{0}')"""


#: One row a call of a supplier's method: who calls is an order's method, and its symbol has the same key.
_CALLERS = "SELECT 'method' AS kind, 'o' || o_orderkey AS name, 'C/' || o_custkey || '.o' || o_orderkey AS display, 'C/' || o_custkey AS class FROM lineitem JOIN orders ON l_orderkey = o_orderkey "


def _paged(body: str, order: str, offset: int, limit: int) -> str:
    return f"""SELECT r.*, t.total, least({offset}, t.total) AS "offset", CAST({limit} AS BIGINT) AS "limit", least({limit}, t.total - least({offset}, t.total)) AS returned,
least({offset}, t.total) + least({limit}, t.total - least({offset}, t.total)) < t.total AS has_more
FROM (SELECT * FROM ({body}) ORDER BY {order} LIMIT {limit} OFFSET {offset}) r, (SELECT count(*) AS total FROM ({body})) t"""


_GREP = r"""SELECT fqn AS class, cls_idx, CAST(min(line_no) - 1 AS INTEGER) AS line_no, CASE WHEN length(text) > 240 THEN text[1:240] || '…' ELSE text END AS snippet FROM (
SELECT fqn, cls_idx, line_no, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text FROM (
SELECT *, row_number() OVER (PARTITION BY cls_idx ORDER BY line_no) AS r FROM (
SELECT cls_idx, fqn, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM v_bodies) WHERE {}) WHERE r <= 3)
GROUP BY fqn, cls_idx, text"""

_ENTRIES: dict[str, tuple[Query, str | None]] = {
    "xrefs_to_class": (lambda t: graph.class_users(t.classes, t.symbols, t.edges, "N/7"), _USERS.format("N/7")),
    "xrefs_to_class_page": (lambda t: page(graph.class_users(t.classes, t.symbols, t.edges, "N/7"), "class", offset=5, limit=20), _paged(_USERS.format("N/7"), "class", 5, 20)),
    "xrefs_to_method": (lambda t: graph.xrefs_to_method(t.methods, t.symbols, t.edges, "S/1", "p1"), _CALLERS + "WHERE l_suppkey = 1 AND l_partkey = 1"),
    "xrefs_to_methods_of_class": (lambda t: graph.incoming(t.symbols, t.edges, CALLS, t.methods.where("cls_dex = 'S/1'")), _CALLERS + "WHERE l_suppkey = 1"),
    "xrefs_from_method": (
        lambda t: graph.outgoing(t.symbols, t.edges, CALLS, t.methods.where("name = 'o1'")),
        "SELECT 'method' AS kind, 'p' || l_partkey AS name, 'S/' || l_suppkey || '.p' || l_partkey AS display, 'S/' || l_suppkey AS class FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey = 1",
    ),
    "xrefs_to_field": (
        lambda t: graph.xrefs_to_field(t.fields, t.symbols, t.edges, "B/Brand#1", "large widget"),
        f"SELECT {_MEMBER} FROM v_edges e JOIN v_symbols s ON e.src = s.dex_id WHERE e.type = 2 AND e.dst = (SELECT min(dex_id) FROM v_fields WHERE cls_dex = 'B/Brand#1' AND name = 'large widget')",
    ),
    "outgoing_class_uses": (lambda t: graph.outgoing(t.symbols, t.edges, USES_CLASS, "C/1"), f"SELECT {_MEMBER} FROM v_edges e JOIN v_symbols s ON e.dst = s.dex_id WHERE e.type = 1 AND e.src = 'C/1'"),
    "xrefs_from_class": (lambda t: graph.call_graph(t.classes, t.symbols, t.edges, "C/1"), _CALLED.format("C/1")),
    "call_graph": (lambda t: page(graph.call_graph(t.classes, t.symbols, t.edges, "C/1"), "class", limit=10), _paged(_CALLED.format("C/1"), "class", 0, 10)),
    "subclasses": (lambda t: graph.subtypes(t.symbols, t.edges, "R/0"), "SELECT coalesce(s.display, s.cls_dex) AS class, 'extends' AS relation FROM v_edges e JOIN v_symbols s ON e.src = s.dex_id WHERE e.type = 3 AND e.dst = 'R/0'"),
    "implementers": (lambda t: graph.subtypes(t.symbols, t.edges, "I/MACHINERY"), "SELECT coalesce(s.display, s.cls_dex) AS class, 'implements' AS relation FROM v_edges e JOIN v_symbols s ON e.src = s.dex_id WHERE e.type = 4 AND e.dst = 'I/MACHINERY'"),
    "subtypes_by_super": (
        lambda t: graph.subtypes_by_super(t.edges).select("super", F.array_join("subs", ",").alias("subs")),
        "SELECT dst AS super, string_agg(src, ',' ORDER BY src) AS subs FROM (SELECT DISTINCT src, dst FROM v_edges WHERE type IN (3, 4)) GROUP BY dst",
    ),
    "edge_stats": (lambda t: graph.edge_stats(t.edges), "SELECT type, CAST(sum(n) AS BIGINT) AS edges, count(*) AS pairs FROM (SELECT type, src, dst, count(*) AS n FROM v_edges GROUP BY ALL) GROUP BY type"),
    "symbol_stats": (lambda t: graph.symbol_stats(t.symbols), "SELECT CASE kind WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'field' END AS kind, count(*) AS symbols, count(DISTINCT cls_dex) AS owners FROM v_symbols GROUP BY kind"),
    "first_symbols": (
        lambda t: graph.first_symbols(t.read("lineitem").select(F.concat(F.lit("S/"), "l_suppkey").alias("dex_id"), F.col("l_shipdate").cast("string").alias("display"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("seq"))),
        "SELECT 'S/' || l_suppkey AS dex_id, strftime(first(l_shipdate ORDER BY l_orderkey, l_linenumber, l_shipdate), '%Y-%m-%d %H:%M:%S') AS display FROM lineitem GROUP BY l_suppkey",
    ),
    "usage_export": (
        lambda t: graph.export_usage(t.read("customer").groupBy(F.concat(F.lit("N/"), "c_nationkey").alias("node")).agg(F.collect_list(F.concat(F.lit("C/"), "c_custkey")).alias("users")), USES_CLASS),
        "SELECT 'C/' || c_custkey AS src, 'N/' || c_nationkey AS dst, 1 AS type FROM customer",
    ),
    "package_tree": (lambda t: page(catalog.package_tree(t.bodies), "package", limit=50), _paged("SELECT coalesce(pkg, '') AS package, count(*) AS classes FROM v_bodies GROUP BY 1", "package", 0, 50)),
    "all_classes_page": (
        lambda t: page(t.classes.select(F.col("fqn").alias("class"), "cls_idx"), "cls_idx", offset=30, limit=25),
        _paged("SELECT fqn AS class, cls_idx FROM v_classes", "cls_idx", 30, 25),
    ),
    "resolve_class_by_name": (lambda t: catalog.resolve_class(t.classes, "supp.Supplier#000000001"), "SELECT * FROM v_classes WHERE fqn = 'supp.Supplier#000000001' OR dex_id = 'supp.Supplier#000000001' ORDER BY fqn <> 'supp.Supplier#000000001', cls_idx DESC LIMIT 1"),
    "resolve_class_by_key": (lambda t: catalog.resolve_class(t.classes, "C/7"), "SELECT * FROM v_classes WHERE fqn = 'C/7' OR dex_id = 'C/7' ORDER BY fqn <> 'C/7', cls_idx DESC LIMIT 1"),
    "methods_of_class": (lambda t: catalog.methods_of_class(t.methods, "C/1"), "SELECT name, name || '()' AS descriptor, return_type, constructor FROM v_methods WHERE cls_dex = 'C/1'"),
    "fields_of_class": (lambda t: catalog.fields_of_class(t.fields, "B/Brand#2"), "SELECT name, type FROM v_fields WHERE cls_dex = 'B/Brand#2'"),
    "class_source": (lambda t: catalog.body_of_class(t.bodies, 5), "SELECT fqn AS class, body AS source FROM v_bodies WHERE cls_idx = 5"),
    "raw_source": (lambda t: catalog.body_of_class(t.raw_bodies, 5), "SELECT url AS class, html AS source FROM pages WHERE page_id = 5"),
    "search_classes_by_keyword": (lambda t: catalog.search_classes(t.classes, "MACHINERY"), "SELECT fqn AS class FROM v_classes WHERE contains(lower(fqn), 'machinery') ORDER BY cls_idx, fqn LIMIT 200"),
    "search_method_by_name": (
        lambda t: catalog.search_methods(t.classes, t.methods, "O12", 2000),
        "SELECT coalesce(c.fqn, m.cls_dex) AS class, m.name AS method, m.name || '()' AS descriptor FROM v_methods m LEFT JOIN v_classes c ON c.dex_id = m.cls_dex WHERE contains(lower(m.name), 'o12') ORDER BY 1, 2, 3 LIMIT 2000",
    ),
    "resource_files": (lambda t: page(t.resources.select("name"), "name", limit=40), _paged("SELECT name FROM v_resources", "name", 0, 40)),
    "resource_file": (lambda t: catalog.resource(t.resources, t.read("pages").where("page_id = 3").first().url), "SELECT * FROM v_resources WHERE name = (SELECT url FROM pages WHERE page_id = 3) ORDER BY content LIMIT 1"),
    "resource_file_unknown": (lambda t: catalog.resource(t.resources, "no such file"), "SELECT * FROM v_resources WHERE name = 'no such file' LIMIT 1"),
    "content_keys": (
        lambda t: t.resources.select("name", strings.content_key(F.octet_length("content"), F.col("content")).alias("key")),
        "SELECT name, substr(sha256(octet_length(encode(content)) || content), 1, 16) AS key FROM v_resources",
    ),
    "simple_names": (lambda t: t.classes.select("dex_id", strings.simple_name(F.col("fqn")).alias("name"), strings.member_id(F.col("dex_id"), F.lit("x")).alias("member")), "SELECT dex_id, string_split(fqn, '.')[-1] AS name, dex_id || '->x' AS member FROM v_classes"),
    "search_code_index": (lambda t: text.search_bodies(t.bodies, "the by"), "SELECT fqn AS class, cls_idx FROM v_bodies WHERE contains(lower(body), 'the by')"),
    "search_code_accents": (lambda t: text.search_bodies(t.bodies, "ÉAU"), "SELECT fqn AS class, cls_idx FROM v_bodies WHERE contains(lower(body), 'éau')"),
    "search_code_by_postings": (lambda t: text.search_by_index(t.bodies, stored_postings(t), "the by"), "SELECT fqn AS class, cls_idx FROM v_bodies WHERE contains(lower(body), 'the by')"),
    "search_code_lines": (lambda t: text.scan_lines(t.bodies, "the", False), _GREP.format("contains(line, 'the')")),
    "search_code_regex": (lambda t: text.scan_lines(t.bodies, r"\bth[aeiou]+ b[a-z]*", True), _GREP.format(r"regexp_matches(line, '\bth[aeiou]+ b[a-z]*')")),
    "search_in_code": (
        lambda t: text.search_code(t.bodies, "the by", limit=50),
        "SELECT 'substring' AS engine, fqn AS class, cls_idx, CAST(NULL AS VARCHAR) AS snippet FROM v_bodies WHERE contains(lower(body), 'the by') ORDER BY cls_idx LIMIT 50",
    ),
    "trigram_postings": (
        lambda t: text.postings(t.bodies).groupBy("gram").agg(F.count("*").alias("classes")),
        "SELECT gram, count(DISTINCT cls_idx) AS classes FROM (SELECT cls_idx, unnest(list_transform(range(1, greatest(length(b) - 1, 1)), lambda k: substr(b, k, 3))) AS gram FROM (SELECT cls_idx, lower(body) AS b FROM v_bodies)) GROUP BY gram",
    ),
    "trigram_candidates": (
        lambda t: text.candidates(stored_postings(t), "than"),
        "SELECT cls_idx FROM v_bodies WHERE contains(lower(body), 'tha') AND contains(lower(body), 'han')",
    ),
    "string_constants": (lambda t: t.literals, "SELECT str, cls_idx FROM v_literals"),
    "search_string_constants": (lambda t: text.search_strings(t.literals, t.raw_bodies, "THA", 2000), "SELECT str AS string, url AS class FROM v_literals LEFT JOIN pages ON page_id = cls_idx WHERE contains(lower(str), 'tha') ORDER BY cls_idx, str LIMIT 2000"),
    "search_string_constants_short": (lambda t: text.search_strings(t.literals, t.raw_bodies, "E_", 2000), "SELECT str AS string, url AS class FROM v_literals LEFT JOIN pages ON page_id = cls_idx WHERE str ILIKE '%e_%' ORDER BY cls_idx, str LIMIT 2000"),
    "find_string_usages": (lambda t: text.string_usages(t.literals, t.raw_bodies, "en", False, 2000), "SELECT DISTINCT url AS class, str AS string FROM v_literals LEFT JOIN pages ON page_id = cls_idx WHERE str = 'en' ORDER BY 1, 2 LIMIT 2000"),
    "find_string_usages_contains": (lambda t: text.string_usages(t.literals, t.raw_bodies, "Tion", True, 2000), "SELECT DISTINCT url AS class, str AS string FROM v_literals LEFT JOIN pages ON page_id = cls_idx WHERE str ILIKE '%tion%' ORDER BY 1, 2 LIMIT 2000"),
    "string_resources": (
        lambda t: extract.string_resources(t.string_files).drop("pos"),
        "SELECT 'res/' || p_brand || '/strings.xml' AS resource, 'p' || p_partkey AS name, p_name || ' &amp; ' || p_type AS value FROM part",
    ),
    "rename_overlay": (lambda t: overlay.current(t.renames), "SELECT type, cls, id, arg_max(new_name, seq) AS new_name FROM v_renames WHERE type IN ('CLASS', 'METHOD', 'FIELD', 'PACKAGE') GROUP BY type, cls, id"),
    "renamed_classes": (
        lambda t: overlay.renamed_classes(t.classes, t.renames),
        "SELECT cls_idx, dex_id, CASE WHEN own IS NULL THEN now || substr(fqn, length(pkg) + 1) ELSE now || '.' || own END AS fqn, now AS pkg FROM v_now",
    ),
    "renamed_symbols": (
        lambda t: overlay.renamed_symbols(t.symbols, t.renames, t.classes),
        """SELECT s.kind, s.dex_id, s.cls_dex, coalesce(n.new_name, s.name) AS name,
CASE WHEN c.dex_id IS NOT NULL AND c.own IS NULL THEN c.now || substr(c.fqn, length(c.pkg) + 1) WHEN c.dex_id IS NOT NULL THEN c.now || '.' || c.own
WHEN n.new_name IS NULL THEN s.display ELSE substr(s.display, 1, length(s.display) - length(s.name)) || n.new_name END AS display
FROM v_symbols s LEFT JOIN (SELECT CASE type WHEN 'CLASS' THEN cls ELSE cls || '->' || id END AS ref, arg_max(new_name, seq) AS new_name FROM v_renames WHERE type IN ('CLASS', 'METHOD', 'FIELD') GROUP BY 1) n ON n.ref = s.dex_id
LEFT JOIN v_now c ON s.kind = 0 AND c.dex_id = s.dex_id""",
    ),
    "renamed_methods": (
        lambda t: overlay.renamed_members(t.methods, t.renames).where("name LIKE 'settle%'"),
        "SELECT 'C/' || o_custkey AS cls_dex, 'C/' || o_custkey || '->o' || o_orderkey AS dex_id, 'settle' || o_orderkey AS name, 'o' || o_orderkey || '()' AS descriptor, o_orderpriority AS return_type, o_orderstatus = 'P' AS constructor FROM orders WHERE o_orderkey < 5",
    ),
    "pending_classes": (lambda t: catalog.pending(t.bodies.select(F.col("cls_idx").alias("doc_id"), "fqn"), t.read("labels"), "doc_id"), "SELECT cls_idx AS doc_id, fqn FROM v_bodies WHERE cls_idx NOT IN (SELECT doc_id FROM labels)"),
    "index_status": (
        lambda t: status_row(t.bodies, t.read("labels"), t.symbols, t.edges, t.literals),
        "SELECT *, CASE WHEN total_classes > 0 THEN least(100, CAST(floor(100.0 * indexed_classes / total_classes) AS BIGINT)) ELSE 0 END AS percent FROM (SELECT (SELECT count(*) FROM documents) AS total_classes, (SELECT count(*) FROM labels) AS indexed_classes, (SELECT count(*) FROM v_symbols) AS symbols, (SELECT count(*) FROM v_edges) AS edges, (SELECT count(*) FROM v_literals) AS const_strings)",
    ),
    "json_rows": (lambda t: to_json(t.read("nation")), "SELECT CAST(to_json(nation) AS VARCHAR) AS json FROM nation"),
    "launcher_activity": (
        lambda t: extract.launcher(t.manifests),
        """SELECT 'supp' || s_suppkey || '/AndroidManifest.xml' AS name, CASE s_suppkey % 5 WHEN 0 THEN 'com.s' || s_suppkey || '.Main' || s_suppkey WHEN 1 THEN 'com.s' || s_suppkey || '.Alias' || s_suppkey WHEN 4 THEN 'com.y.Full' ELSE 'no launcher activity found' END AS main_activity,
CASE s_suppkey % 5 WHEN 3 THEN '?' ELSE 'com.s' || s_suppkey END AS package FROM supplier""",
    ),
    "method_slice": (
        lambda t: extract.with_method_slice(t.order_sources, "source", "name", "code").select("o_orderkey", "code"),
        """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '  int o' || o_orderkey || '(int x) {' || chr(10) || '    if (x > 0) { return 1; }' || chr(10) || '    return 0;' || chr(10) || '  }'
WHEN 1 THEN '  int o' || o_orderkey || '(int x);' || chr(10) WHEN 2 THEN '  int o' || o_orderkey || '(int x) { { }' || chr(10) || repeat('y', 394) END AS code FROM orders""",
    ),
}


def _query(run: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(Tables(spark, sf_dir))


QUERIES = {name: _query(run) for name, (run, _) in _ENTRIES.items()}
ORACLES = {name: _sql(sql) for name, (_, sql) in _ENTRIES.items() if sql is not None}
