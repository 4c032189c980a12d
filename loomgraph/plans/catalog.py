"""The driver's queries: each operator of the engine over the projected star schema, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import ingest, joins, lookup, patterns, stats, store, traverse, xref
from loomgraph.operators.schema import DEPENDENCY_KINDS
from loomgraph.operators.tables import shared_dir
from loomgraph.plans import built_catalog
from loomgraph.plans.projection import duckdb_graph, graph
from loomgraph.sources.registry import parse_files, parsed_nodes
from loomgraph.streaming.ingest import apply_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOMER = "cust/{}::customer_{}"
NODE = ["kind", "name", "qualified_name", "file_path", "language"]
EDGE = ["kind", "source_qualified", "target_qualified", "file_path", "line"]
_NODE, _EDGE = ", ".join(NODE), ", ".join(EDGE)
DEEP = 1_000_000_000


def _graph_query(name: str, rows: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rows(*graph(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = f"{duckdb_graph()} {sql}"


def _query(name: str, rows: Query, sql: str | None) -> None:
    QUERIES[name] = rows
    if sql:
        ORACLE_SQL[name] = sql


def _n(rows: DataFrame) -> DataFrame:
    return rows.select(NODE)


def _e(rows: DataFrame) -> DataFrame:
    return rows.select(EDGE)


REGION, SUPPLIER_FILE, ORDER_FILE = "region/0", "supp/3", "ord/7"

# Lookups and filters.
_graph_query("node_lookup", lambda n, e: _n(lookup.node(n, "part/Brand#11")), f"SELECT {_NODE} FROM nodes WHERE qualified_name = 'part/Brand#11'")
_graph_query("file_nodes", lambda n, e: _n(lookup.nodes_of_file(n, ORDER_FILE)), f"SELECT {_NODE} FROM nodes WHERE file_path = '{ORDER_FILE}'")
_graph_query("out_edges", lambda n, e: _e(lookup.edges_from(e, ORDER_FILE)), f"SELECT {_EDGE} FROM edges WHERE source_qualified = '{ORDER_FILE}'")
_graph_query("in_edges", lambda n, e: _e(lookup.edges_to(e, SUPPLIER_FILE)), f"SELECT {_EDGE} FROM edges WHERE target_qualified = '{SUPPLIER_FILE}'")
_graph_query("nodes_by_language", lambda n, e: _n(lookup.nodes_of_language(n, "supply")), f"SELECT {_NODE} FROM nodes WHERE language = 'supply'")
_graph_query("language_nonempty", lambda n, e: lookup.with_language(n).groupBy("language").agg(F.count(F.lit(1)).alias("n")), "SELECT language, count(*) AS n FROM nodes WHERE language IS NOT NULL AND language <> '' GROUP BY language")
_SEARCH = "(lower(name) LIKE '%customer\\_%' ESCAPE '\\' OR lower(qualified_name) LIKE '%customer_%') AND (lower(name) LIKE '%st/1%' OR lower(qualified_name) LIKE '%st/1%')"
_SEARCH = _SEARCH.replace("LIKE '%customer\\_%' ESCAPE '\\'", "LIKE '%customer_%'")
_graph_query("search_nodes", lambda n, e: _n(lookup.search(n, "Customer_ st/1", 20)), f"SELECT {_NODE} FROM nodes WHERE {_SEARCH} ORDER BY ord LIMIT 20")
_graph_query(
    "search_filtered_after_limit", lambda n, e: _n(lookup.search_filtered(n, "supp/", "Resource", "supply", 20)),
    f"SELECT {_NODE} FROM (SELECT * FROM (SELECT * FROM nodes WHERE lower(name) LIKE '%supp/%' OR lower(qualified_name) LIKE '%supp/%' ORDER BY ord LIMIT 40) WHERE kind = 'Resource' AND language = 'supply' ORDER BY ord LIMIT 20)",
)
_graph_query("search_empty", lambda n, e: _n(lookup.search(n, "  ")), f"SELECT {_NODE} FROM nodes WHERE false")
_graph_query("edge_kind_filter", lambda n, e: lookup.of_kinds(e, ["CALLS", "RENDERS"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last")), "SELECT kind, count(*) AS n, max(line) AS last FROM edges WHERE kind IN ('CALLS', 'RENDERS') GROUP BY kind")

# Named patterns, on the least customer with an order.
_KEYS = "(SELECT min(target_qualified) FROM edges WHERE kind = 'CALLS')"


def _keyed(name: str, pattern: Callable[[DataFrame, DataFrame, str], DataFrame], key: str, sql: str) -> None:
    _graph_query(name, lambda n, e: pattern(n, e, key), sql)


_BRAND, _NATION, _ORDER1, _SUPP1 = "part/Brand#12", "region/0::nation_0", "ord/1::order_1", "supp/3::supplier_1"
_SRC = "SELECT " + ", ".join(f"n.{c}" for c in NODE) + " FROM edges e JOIN nodes n ON n.qualified_name = e.source_qualified WHERE e.target_qualified = '{}' AND e.kind IN ({})"
_TGT = "SELECT " + ", ".join(f"n.{c}" for c in NODE) + " FROM edges e JOIN nodes n ON n.qualified_name = e.target_qualified WHERE e.source_qualified = '{}' AND e.kind IN ({})"


def _hot(e: DataFrame, kind: str) -> str:
    """The most frequent target of a kind, the least key of equals."""
    return e.filter(F.col("kind") == kind).groupBy("target_qualified").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "target_qualified").first()[0]


_graph_query(
    "callers_of", lambda n, e: _n(patterns.callers_of(n, e, _hot(e, "CALLS"))),
    "SELECT " + ", ".join(f"n.{c}" for c in NODE) + " FROM edges e JOIN nodes n ON n.qualified_name = e.source_qualified WHERE e.kind = 'CALLS' AND e.target_qualified = (SELECT target_qualified FROM edges WHERE kind = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
)
_keyed("callees_of", lambda n, e, k: _n(patterns.callees_of(n, e, k)), _ORDER1, _TGT.format(_ORDER1, "'CALLS'"))
_keyed("imports_of", patterns.imports_of, ORDER_FILE, f"SELECT target_qualified AS import_target FROM edges WHERE source_qualified = '{ORDER_FILE}' AND kind IN ('IMPORTS', 'IMPORTS_FROM')")
_keyed("importers_of", patterns.importers_of, SUPPLIER_FILE, f"SELECT source_qualified AS importer, file_path AS file FROM edges WHERE target_qualified = '{SUPPLIER_FILE}' AND kind IN ('IMPORTS', 'IMPORTS_FROM')")
_keyed("children_of", lambda n, e, k: _n(patterns.children_of(n, e, k)), REGION, _TGT.format(REGION, "'CONTAINS'"))
_graph_query(
    "tests_for", lambda n, e: _n(patterns.tests_for(n, e, _hot(e, "TESTED_BY"), _hot(e, "TESTED_BY").split("::")[-1])),
    "SELECT " + ", ".join(f"n.{c}" for c in NODE) + " FROM edges e JOIN nodes n ON n.qualified_name = e.source_qualified WHERE e.kind = 'TESTED_BY' AND e.target_qualified = (SELECT target_qualified FROM edges WHERE kind = 'TESTED_BY' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
)
_keyed("inheritors_of", lambda n, e, k: _n(patterns.inheritors_of(n, e, k)), _BRAND, _SRC.format(_BRAND, "'INHERITS', 'IMPLEMENTS'"))
_keyed("file_summary", lambda n, e, k: _n(patterns.file_summary(n, e, k)), REGION, f"SELECT {_NODE} FROM nodes WHERE file_path = '{REGION}'")
_keyed("references_to", lambda n, e, k: _n(patterns.references_to(n, e, k)), _NATION, _SRC.format(_NATION, "'REFERENCES', 'READS_CONFIG', 'RENDERS', 'PASSES_VAR', 'USES_MODULE'"))
_CROSS = "FROM edges e JOIN nodes a ON a.qualified_name = e.source_qualified JOIN nodes b ON b.qualified_name = e.target_qualified WHERE a.language <> b.language AND a.language <> '' AND b.language <> ''"
_graph_query("cross_language_count", patterns.cross_language_count, f"SELECT count(*) AS total_cross_language_edges {_CROSS}")
_graph_query(
    "cross_language_edges", lambda n, e: joins.cross_language(e, n).groupBy("kind", "source_language", "target_language").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT e.kind AS kind, a.language AS source_language, b.language AS target_language, count(*) AS n {_CROSS} GROUP BY 1, 2, 3",
)

# Joins.
_graph_query(
    "edges_among", lambda n, e: _e(joins.edges_among(e, n.filter("language IN ('geo', 'supply')"))),
    f"SELECT {_EDGE} FROM edges WHERE source_qualified IN (SELECT qualified_name FROM nodes WHERE language IN ('geo', 'supply')) AND target_qualified IN (SELECT qualified_name FROM nodes WHERE language IN ('geo', 'supply'))",
)
_graph_query(
    "subgraph_edges", lambda n, e: _e(joins.subgraph_edges(e, n.filter("language = 'geo'").unionByName(n.filter("kind = 'Resource'")).unionByName(n.filter("kind = 'Resource'")))),
    "SELECT e.kind AS kind, e.source_qualified AS source_qualified, e.target_qualified AS target_qualified, e.file_path AS file_path, e.line AS line FROM edges e JOIN (SELECT qualified_name FROM nodes WHERE language = 'geo' UNION ALL SELECT qualified_name FROM nodes WHERE kind = 'Resource' UNION ALL SELECT qualified_name FROM nodes WHERE kind = 'Resource') s ON s.qualified_name = e.source_qualified WHERE e.target_qualified IN (SELECT qualified_name FROM nodes WHERE language = 'geo' OR kind = 'Resource')",
)
_graph_query("file_dependents", lambda n, e: joins.file_dependents(e, n, SUPPLIER_FILE), f"SELECT DISTINCT file_path FROM edges WHERE file_path <> '{SUPPLIER_FILE}' AND ((target_qualified = '{SUPPLIER_FILE}' AND kind IN ('IMPORTS', 'IMPORTS_FROM')) OR (kind IN ('CALLS', 'IMPORTS', 'IMPORTS_FROM', 'INHERITS', 'READS_CONFIG', 'RENDERS', 'REFERENCES') AND target_qualified IN (SELECT qualified_name FROM nodes WHERE file_path = '{SUPPLIER_FILE}')))")
_graph_query(
    "same_file_refs", lambda n, e: joins.within_files(n, ["Class", "Resource"]),
    "SELECT c.qualified_name AS source_qualified, s.qualified_name AS target_qualified FROM nodes c JOIN nodes s ON s.file_path = c.file_path AND s.kind = 'File' WHERE c.kind IN ('Class', 'Resource')",
)
_graph_query(
    "find_node", lambda n, e: joins.found_targets(e.filter("kind = 'INHERITS'"), n).select(F.col("qualified_name").alias("target_qualified"), "name"),
    "SELECT DISTINCT e.target_qualified AS target_qualified, n.name AS name FROM edges e JOIN nodes n ON n.qualified_name = e.target_qualified WHERE e.kind = 'INHERITS'",
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by base name, of which several files have each: the last by order is meant; every fourth names no file."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    refs = t.selectExpr("o_orderkey AS page_id", "concat('some/where/', o_orderkey % 40, '.yaml') AS ref")
    files = t.selectExpr("'File' AS kind", "concat('/p', o_orderkey, '/', o_orderkey % 30, '.yaml') AS file_path", "o_orderkey AS ord").withColumn("qualified_name", F.col("file_path"))
    return joins.resolve_refs(refs, files)


_query(
    "resolve_file_refs", _resolve_refs,
    """WITH f AS (SELECT o_orderkey % 30 AS base, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT o_orderkey AS page_id, 'some/where/' || base || '.yaml' AS ref, '/p' || k || '/' || base || '.yaml' AS target FROM orders JOIN f ON base = o_orderkey % 40""",
)

# Counts.
_graph_query("count_nodes", lambda n, e: stats.count_rows(n), "SELECT count(*) AS n FROM nodes")
_graph_query("count_edges", lambda n, e: stats.count_rows(e), "SELECT count(*) AS n FROM edges")
_graph_query("nodes_by_kind", lambda n, e: stats.by_kind(n), "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
_graph_query("edges_by_kind", lambda n, e: stats.by_kind(e), "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
_graph_query("languages", lambda n, e: stats.languages(n), "SELECT DISTINCT language FROM nodes WHERE language <> ''")
_graph_query("files", lambda n, e: stats.files(n), "SELECT DISTINCT file_path FROM nodes WHERE kind = 'File'")
_graph_query("files_count", lambda n, e: stats.files_count(n), "SELECT count(*) FILTER (kind = 'File') AS files_count FROM nodes")


def _stats_row(n: DataFrame, e: DataFrame) -> DataFrame:
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))), ",")
    return stats.graph_stats(n, e).select("total_nodes", "total_edges", "files_count", text(F.col("nodes_by_kind")).alias("nodes_by_kind"), text(F.col("edges_by_kind")).alias("edges_by_kind"), F.array_join("languages", ",").alias("languages"))


_graph_query(
    "graph_stats", _stats_row,
    "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM nodes WHERE kind = 'File') AS files_count, (SELECT string_agg(kind || '=' || c, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS c FROM nodes GROUP BY kind)) AS nodes_by_kind, (SELECT string_agg(kind || '=' || c, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS c FROM edges GROUP BY kind)) AS edges_by_kind, (SELECT string_agg(language, ',' ORDER BY language) FROM (SELECT DISTINCT language FROM nodes WHERE language <> '')) AS languages",
)
_graph_query(
    "build_totals", lambda n, e: stats.totals(n, e),
    "SELECT count(*) AS files, sum(a)::BIGINT AS nodes, sum(coalesce(b, 0))::BIGINT AS edges FROM (SELECT file_path, count(*) AS a FROM nodes GROUP BY 1) x LEFT JOIN (SELECT file_path, count(*) AS b FROM edges GROUP BY 1) y USING (file_path)",
)
_graph_query("names_by_kind", lambda n, e: stats.names_of(n, "File").select("name", F.array_join("keys", ",").alias("files")), "SELECT name, string_agg(qualified_name, ',' ORDER BY qualified_name) AS files FROM nodes WHERE kind = 'File' GROUP BY name")

# Traversal.
_KINDS = ", ".join(f"'{k}'" for k in DEPENDENCY_KINDS)
_BFS = f""", adj AS (SELECT source_qualified AS a, target_qualified AS b, arg_max(kind, ord) AS kind FROM edges GROUP BY 1, 2),
links AS (SELECT a, b FROM adj WHERE kind IN ({_KINDS}) UNION ALL SELECT b, a FROM adj WHERE kind IN ({_KINDS})),
walk AS (SELECT qualified_name, 0 AS depth FROM nodes WHERE file_path = '{REGION}' UNION SELECT b, depth + 1 FROM walk JOIN links ON a = qualified_name WHERE depth < 2),
reached AS (SELECT qualified_name, min(depth) AS depth FROM walk GROUP BY 1),
hit AS (SELECT n.kind, n.qualified_name, n.file_path, r.depth FROM nodes n JOIN reached r USING (qualified_name))"""


def _impact(n: DataFrame, e: DataFrame, max_nodes: int = DEEP) -> traverse.Impact:
    return traverse.impact(n, e, n.sparkSession.createDataFrame([(REGION,)], "file_path string"), 2, max_nodes)


_graph_query("adjacency_last_wins", lambda n, e: traverse.adjacency(e).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM (SELECT arg_max(kind, ord) AS kind FROM edges GROUP BY source_qualified, target_qualified) GROUP BY kind")
_graph_query("impact_nodes", lambda n, e: _impact(n, e).nodes.select("kind", "qualified_name", "file_path", "depth"), f"{_BFS} SELECT * FROM hit WHERE depth > 0")
_graph_query("impact_levels", lambda n, e: traverse.levels(n, e, n.sparkSession.createDataFrame([(REGION,)], "file_path string"), 2, DEEP).groupBy("depth").agg(F.count(F.lit(1)).alias("n")), f"{_BFS} SELECT depth, count(*) AS n FROM reached GROUP BY depth")
_graph_query("impact_files", lambda n, e: _impact(n, e).files, f"{_BFS} SELECT DISTINCT file_path FROM hit WHERE depth > 0")
_graph_query("impact_edges", lambda n, e: _impact(n, e).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), f"{_BFS} SELECT kind, count(*) AS n FROM edges WHERE source_qualified IN (SELECT qualified_name FROM hit) AND target_qualified IN (SELECT qualified_name FROM hit) GROUP BY kind")
_graph_query("impact_changed", lambda n, e: _n(_impact(n, e).changed), f"SELECT {_NODE} FROM nodes WHERE file_path = '{REGION}'")


def _truncated(n: DataFrame, e: DataFrame) -> DataFrame:
    found = _impact(n, e, 25)
    return found.nodes.select("qualified_name", "depth", F.lit(found.total).cast("long").alias("total"), F.lit(found.truncated).alias("truncated"))


_graph_query("impact_truncated", _truncated, f"{_BFS}, one AS (SELECT * FROM hit WHERE depth = 1) SELECT qualified_name, depth, (SELECT count(*) FROM one) AS total, (SELECT count(*) FROM one) > 25 AS truncated FROM one ORDER BY depth, qualified_name LIMIT 25")

# Mutations.
_graph_query(
    "upsert_nodes_last_wins", lambda n, e: store.upsert_nodes(n.unionByName(n.filter("kind = 'Class'").withColumn("name", F.concat(F.lit("new "), "name")).withColumn("ord", F.col("ord") + 10**15))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").startswith("new ")).alias("renamed"), F.max("ord").alias("last")),
    "SELECT kind, count(*) AS n, count(*) FILTER (kind = 'Class') AS renamed, max(ord) AS last FROM nodes GROUP BY kind",
)
_graph_query(
    "upsert_edges", lambda n, e: store.upsert_edges(e.withColumn("extra", F.lit("first")).unionByName(e.filter("kind = 'CALLS'").withColumn("extra", F.lit("last")).withColumn("ord", F.col("ord") + 10**15))).groupBy("kind", "extra").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")),
    "SELECT kind, CASE WHEN kind = 'CALLS' THEN 'last' ELSE 'first' END AS extra, count(*) AS n, min(ord) AS first FROM (SELECT kind, source_qualified, target_qualified, file_path, line, min(ord) AS ord FROM edges GROUP BY 1, 2, 3, 4, 5) GROUP BY kind",
)
_graph_query("remove_file", lambda n, e: store.remove_files(e, n.filter(F.col("file_path") == ORDER_FILE)).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")), f"SELECT file_path, count(*) AS n FROM edges WHERE file_path <> '{ORDER_FILE}' GROUP BY file_path")
_graph_query("replace_file", lambda n, e: store.replace_files(n, n.filter(F.col("file_path") == ORDER_FILE), n.filter(F.col("file_path") == ORDER_FILE).limit(0).unionByName(n.filter(F.col("qualified_name") == ORDER_FILE))).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")), f"SELECT file_path, count(*) AS n FROM nodes WHERE file_path <> '{ORDER_FILE}' OR qualified_name = '{ORDER_FILE}' GROUP BY file_path")
_graph_query("purge_stale", lambda n, e: store.stale_files(n, n.filter("kind = 'File' AND qualified_name <> 'ord/7'"), "ord"), "SELECT DISTINCT file_path FROM nodes WHERE kind = 'File' AND file_path = 'ord/7'")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file_path"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))


_query("content_hash", _hashes, "SELECT doc_id::VARCHAR AS file_path, sha256(text) AS file_hash FROM documents")
_query(
    "changed_by_hash", lambda s, d: store.changed_files(_hashes(s, d).filter(~F.col("file_path").endswith("3")), _hashes(s, d).filter(~F.col("file_path").endswith("4")).withColumn("file_hash", F.when(F.col("file_path").endswith("5"), "x").otherwise(F.col("file_hash")))),
    "SELECT doc_id::VARCHAR AS file_path, CASE doc_id % 10 WHEN 3 THEN 'added' WHEN 4 THEN 'deleted' ELSE 'changed' END AS state FROM documents WHERE doc_id % 10 IN (3, 4, 5)",
)

# Scalar functions, over the text tables.
_query("ignore_filter", lambda s, d: _pages(s, d).filter(~C.matches_any(F.col("url"), ["*.example/*1", "http*/?*7"])).select("page_id"), "SELECT page_id FROM pages WHERE NOT regexp_full_match(url, '(.*\\.example/.*1)|(http.*/..*7)')")
_query("extension_filter", lambda s, d: _pages(s, d).select("page_id", C.suffix(F.concat("url", F.lit(".Html"))).alias("suffix"), C.base_name(F.col("url")).alias("base"), C.parent_dir(F.col("url")).alias("folder")), "SELECT page_id, CASE WHEN url LIKE '%/' THEN '' ELSE '.html' END AS suffix, list_last(string_split(url, '/')) AS base, regexp_replace(url, '/[^/]*$', '') AS folder FROM pages")
_query("binary_sniff", lambda s, d: _pages(s, d).select("page_id", C.has_binary_mark(F.concat(F.col("html"), F.when(F.col("page_id") % 2 == 0, F.lit("\x00")).otherwise(F.lit(""))).cast("binary")).alias("binary")), "SELECT page_id, page_id % 2 = 0 AND octet_length(encode(html)) < 8192 AS binary FROM pages")
_query("sanitize_names", lambda s, d: _pages(s, d).select("page_id", C.sanitize(F.concat(F.lit("\x01\r"), "html")).alias("name")), "SELECT page_id, substr(regexp_replace(html, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), 1, 256) AS name FROM pages")
_query("line_counts", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", C.line_count(F.col("text")).alias("lines")), "SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines FROM documents")
_query("collapse_spaces", lambda s, d: _pages(s, d).select("page_id", C.collapse_spaces(F.col("html")).alias("html")), "SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS html FROM pages")
_query(
    "numbered_snippet", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", C.numbered(F.col("text"), 200).alias("snippet")),
    """WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls[1:200], lambda x, i: i || ': ' || x), chr(10)) || CASE WHEN len(ls) > 200 THEN chr(10) || '... (' || (len(ls) - 200) || ' more lines)' ELSE '' END AS snippet FROM l""",
)


# Detectors of edges across files, over code-like rows made from the tables.
def _detected(name: str, detector: Callable[[DataFrame, DataFrame], DataFrame], nodes: str, edges: str, oracle: str) -> None:
    """``nodes`` and ``edges`` are SQL over the views in braces; every detector gets whole tables."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = {v: spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in ("orders", "customer", "supplier", "pages")}
        n, e = (spark.sql(q, **{k: v for k, v in t.items() if "{" + k + "}" in q}) for q in (nodes, edges))
        return detector(n, e).select("kind", "source_qualified", "target_qualified", "line")

    _query(name, rows, oracle)


_CODE_NODES = (
    "SELECT 'Function' AS kind, concat('f', o_orderkey) AS name, concat('/o/', o_custkey, '.py::f', o_orderkey) AS qualified_name, concat('/o/', o_custkey, '.py') AS file_path, 'python' AS language, '{{}}' AS extra, o_orderkey AS ord FROM {orders} "
    "UNION ALL SELECT 'File', concat(s_suppkey, '.yaml'), concat('/s/', s_suppkey, '.yaml'), concat('/s/', s_suppkey, '.yaml'), 'yaml', '{{}}', s_suppkey FROM {supplier} "
    "UNION ALL SELECT 'File', concat(s_suppkey, '.j2'), concat('/s/', s_suppkey, '.j2'), concat('/s/', s_suppkey, '.j2'), 'jinja2', '{{}}', s_suppkey FROM {supplier}"
).replace("'{{}}'", "''")
_CODE_EDGES = (
    "SELECT 'CALLS' AS kind, concat('/o/', o_custkey, '.py::f', o_orderkey) AS source_qualified, CASE WHEN o_orderkey % 3 = 0 THEN 'yaml::safe_load' ELSE 'env::get_template' END AS target_qualified, concat('/o/', o_custkey, '.py') AS file_path, "
    "CAST(o_orderkey % 100 AS INT) AS line, to_json(named_struct('raw_target', concat('x/', o_orderkey % 150, CASE WHEN o_orderkey % 2 = 0 THEN '.yaml' ELSE '.j2' END))) AS extra, o_orderkey AS ord FROM {orders}"
)
_detected(
    "xref_call_config", xref.calls_to_config, _CODE_NODES, _CODE_EDGES,
    """WITH c AS (SELECT o_custkey AS f, o_orderkey AS k FROM orders),
r AS (SELECT a.f, a.k, b.k % 150 AS s FROM c a JOIN c b USING (f) JOIN supplier ON s_suppkey = b.k % 150 WHERE a.k % 3 = 0 AND b.k % 2 = 0)
SELECT 'READS_CONFIG' AS kind, '/o/' || f || '.py::f' || k AS source_qualified, '/s/' || s || '.yaml' AS target_qualified, (k % 100)::INT AS line FROM r GROUP BY f, k, s""",
)
_detected(
    "xref_call_template", xref.calls_to_template, _CODE_NODES, _CODE_EDGES,
    """SELECT 'RENDERS' AS kind, '/o/' || o_custkey || '.py::f' || o_orderkey AS source_qualified, '/s/' || s_suppkey || CASE WHEN o_orderkey % 2 = 0 THEN '.yaml' ELSE '.j2' END AS target_qualified, (o_orderkey % 100)::INT AS line
FROM orders JOIN supplier ON s_suppkey = o_orderkey % 150 WHERE o_orderkey % 3 <> 0""",
)
_HCL_NODES = (
    "SELECT 'Local' AS kind, concat('l', o_orderkey) AS name, concat('/h/', o_orderkey % 9, '/m.tf::l', o_orderkey) AS qualified_name, concat('/h/', o_orderkey % 9, '/m.tf') AS file_path, 'hcl' AS language, "
    "to_json(named_struct('value', concat('yamldecode(file(\"c/', o_custkey, '.yaml\")) templatefile(\"', o_orderkey % 150, '.j2\", var.x) file(\"', o_custkey, '.txt\")'))) AS extra, o_orderkey AS ord FROM {orders} "
    "UNION ALL SELECT 'File', concat(s_suppkey, '.yaml'), concat('/s/', s_suppkey, '.yaml'), concat('/s/', s_suppkey, '.yaml'), 'yaml', '', s_suppkey FROM {supplier} "
    "UNION ALL SELECT 'File', concat(s_suppkey, '.j2'), concat('/s/', s_suppkey, '.j2'), concat('/s/', s_suppkey, '.j2'), 'jinja2', '', s_suppkey FROM {supplier}"
)
_detected(
    "xref_text_refs", xref.text_to_file, _HCL_NODES, _CODE_EDGES,
    """WITH n AS (SELECT o_orderkey AS k, '/h/' || o_orderkey % 9 || '/m.tf::l' || o_orderkey AS q, 'yamldecode(file("c/' || o_custkey || '.yaml")) templatefile("' || o_orderkey % 150 || '.j2", var.x) file("' || o_custkey || '.txt")' AS v FROM orders),
r AS (SELECT q, unnest(regexp_extract_all(v, '(?:file|yamldecode|templatefile)\\s*\\(\\s*"([^"]+)"', 1)) AS ref FROM n),
f AS (SELECT s_suppkey || '.yaml' AS base FROM supplier UNION ALL SELECT s_suppkey || '.j2' FROM supplier)
SELECT DISTINCT CASE WHEN ref LIKE '%.j2' THEN 'RENDERS' ELSE 'READS_CONFIG' END AS kind, q AS source_qualified, '/s/' || base AS target_qualified, 0 AS line FROM r JOIN f ON base = list_last(string_split(ref, '/'))""",
)
_REMOTE_NODES = (
    "SELECT 'DataSource' AS kind, concat('terraform_remote_state.c', c_custkey % 20) AS name, concat('/h/', c_nationkey, '/m.tf::terraform_remote_state.c', c_custkey % 20) AS qualified_name, concat('/h/', c_nationkey, '/m.tf') AS file_path, 'hcl' AS language, '' AS extra, c_custkey AS ord FROM {customer} "
    "UNION ALL SELECT 'Output', concat('o', s_suppkey), concat('/h/', s_nationkey, '/m.tf::o', s_suppkey), concat('/h/', s_nationkey, '/m.tf'), 'hcl', "
    "to_json(named_struct('value', concat('data.terraform_remote_state.c', s_suppkey % 20, '.outputs.o', s_suppkey % 7))), s_suppkey FROM {supplier}"
)
_detected(
    "xref_remote_outputs", xref.remote_outputs, _REMOTE_NODES, _CODE_EDGES,
    """WITH d AS (SELECT DISTINCT c_nationkey AS n, c_custkey % 20 AS c FROM customer), u AS (SELECT DISTINCT s_nationkey AS n, s_suppkey % 20 AS c, s_suppkey % 7 AS o FROM supplier)
SELECT 'REMOTE_STATE' AS kind, '/h/' || d.n || '/m.tf::terraform_remote_state.c' || d.c AS source_qualified, '/h/' || s.s_nationkey || '/m.tf::o' || s.s_suppkey AS target_qualified, 0 AS line
FROM d JOIN u ON u.n = d.n AND u.c = d.c JOIN supplier s ON s.s_suppkey = u.o WHERE s.s_nationkey <> d.n""",
)


# Parsers and builds, over files made from rows.
def _made_files(ending: str, text: str) -> Query:
    """A parser's rows for one file a customer, its text made of the customer's columns."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = spark.sql("SELECT concat('/c/', c_custkey, '" + ending + "') AS file_path, CAST(" + text + " AS BINARY) AS content FROM {customer}", customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
        parsed = parse_files(made)
        return parsed_nodes(parsed).select("kind", "name", "file_path", "line_start", "line_end")

    return rows


_query(
    "parse_python", _made_files(".py", "concat('import os\\n\\nclass C', c_custkey, ':\\n    def m(self):\\n        return os.getcwd()\\n')"),
    """SELECT unnest(['File', 'Class', 'Method']) AS kind, unnest([c_custkey || '.py', 'C' || c_custkey, 'm']) AS name, '/c/' || c_custkey || '.py' AS file_path, unnest([1, 3, 4])::INT AS line_start, unnest([6, 5, 5])::INT AS line_end FROM customer""",
)
_query(
    "parse_hcl", _made_files(".tf", "concat('variable \"v', c_nationkey, '\" {{ default = 1 }}\\nresource \"a_b\" \"r\" {{ x = var.v }}\\n')"),
    """SELECT unnest(['File', 'Variable', 'Resource']) AS kind, unnest([c_custkey || '.tf', 'v' || c_nationkey, 'a_b.r']) AS name, '/c/' || c_custkey || '.tf' AS file_path, 0 AS line_start, 0 AS line_end FROM customer""",
)
_query(
    "parse_yaml", _made_files(".yaml", "concat('segment: ', c_mktsegment, '\\nn', c_nationkey, ': &a {{k: 1}}\\n')"),
    """SELECT unnest(['File', 'Anchor', 'Section', 'Section']) AS kind, unnest([c_custkey || '.yaml', '&a', 'segment', 'n' || c_nationkey]) AS name, '/c/' || c_custkey || '.yaml' AS file_path, unnest([1, 2, 1, 2])::INT AS line_start, unnest([3, 2, 1, 2])::INT AS line_end FROM customer""",
)
_query(
    "parse_jinja", _made_files(".j2", "concat('{{% block b', c_nationkey, ' %}}\\n{{{{ v }}}}{{% endblock %}}')"),
    """SELECT unnest(['File', 'Template', 'Block', 'Variable']) AS kind, unnest([c_custkey || '.j2', 'template', 'b' || c_nationkey, 'v']) AS name, '/c/' || c_custkey || '.j2' AS file_path, unnest([1, 1, 1, 2])::INT AS line_start, unnest([2, 2, 2, 2])::INT AS line_end FROM customer""",
)


def _repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Terraform file for each customer, which reads a YAML file of its nation."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return spark.sql(
        "SELECT concat('/repo/c', c_custkey, '.tf') AS file_path, CAST(concat('locals {{ a = yamldecode(file(\"n', c_nationkey, '.yaml\")) }}\n') AS BINARY) AS content FROM {customer} "
        "UNION ALL SELECT concat('/repo/n', n_nationkey, '.yaml'), CAST('name: n\n' AS BINARY) FROM {nation}", customer=customer, nation=nation,
    )


def _built(spark: SparkSession, sf_dir: str) -> store.GraphStore:
    held = store.GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ingest.build_files(held, _repository(spark, sf_dir), ["/repo"])
    return held


def _full_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).edges.groupBy("kind", "target_qualified").agg(F.count(F.lit(1)).alias("n"))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the build, customers with even keys lose their files; the others get new contents, but for every third, which is the same again."""
    held, files = _built(spark, sf_dir), _repository(spark, sf_dir).filter("file_path LIKE '%.tf'")
    key = F.regexp_extract("file_path", r"(\d+)\.tf$", 1).cast("long")
    changed = files.select("file_path", F.when(key % 2 == 0, F.lit(None)).when(key % 3 == 0, F.col("content")).otherwise(F.encode(F.lit("locals { b = 1 }\n"), "UTF-8")).alias("content"))
    apply_batch(held, changed)
    return held.nodes.filter("kind = 'Local'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_query(
    "full_build_demo", _full_build,
    """SELECT 'CONTAINS' AS kind, '/repo/c' || c_custkey || '.tf::a' AS target_qualified, 1 AS n FROM customer UNION ALL SELECT 'CONTAINS', '/repo/n' || n_nationkey || '.yaml::name', 1 FROM nation
UNION ALL SELECT 'READS_CONFIG', '/repo/n' || c_nationkey || '.yaml', count(*) FROM customer GROUP BY c_nationkey""",
)
_query("incremental_demo", _incremental, "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS name, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1")

# Parsers, builds and the public interface in full.
QUERIES.update(built_catalog.QUERIES)
ORACLE_SQL.update(built_catalog.ORACLE_SQL)
