"""The named one-hop queries, and how a target's text finds its node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import joins, lookup

#: Kinds of edges by which one node refers to another.
REFERRING = "PASSES_VAR READS_CONFIG REFERENCES RENDERS USES_MODULE".split()
Rows = Callable[[DataFrame, DataFrame, str], DataFrame]


def callers_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that call a node."""
    return joins.sources_of(lookup.edges_to(edges, key, ["CALLS"]), nodes)


def callees_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that a node calls."""
    return joins.targets_of(lookup.edges_from(edges, key, ["CALLS"]), nodes)


def imports_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(import_target) of what a node imports, known or not."""
    return lookup.edges_from(edges, key, ["IMPORTS", "IMPORTS_FROM"]).select(F.col("target_qualified").alias("import_target"))


def importers_of(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(importer, file) of imports of a file."""
    return lookup.edges_to(edges, path, ["IMPORTS", "IMPORTS_FROM"]).select(F.col("source_qualified").alias("importer"), F.col("file_path").alias("file"))


def children_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that a node contains."""
    return joins.targets_of(lookup.edges_from(edges, key, ["CONTAINS"]), nodes)


def tests_for(nodes: DataFrame, edges: DataFrame, key: str, name: str) -> DataFrame:
    """Nodes that test a node, and test nodes named after it."""
    linked = joins.sources_of(lookup.edges_to(edges, key, ["TESTED_BY"]), nodes).select(nodes.columns)
    named = lookup.search(nodes, f"test_{name}", 10).filter("is_test").join(linked.select("qualified_name"), "qualified_name", "left_anti")
    return linked.unionByName(named.select(nodes.columns))


def inheritors_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that inherit from a node or implement it."""
    return joins.sources_of(lookup.edges_to(edges, key, ["INHERITS", "IMPLEMENTS"]), nodes)


def file_summary(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """The nodes of a file."""
    return lookup.nodes_of_file(nodes, path)


def references_to(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that refer to a node."""
    return joins.sources_of(lookup.edges_to(edges, key, REFERRING), nodes)


def cross_language_count(nodes: DataFrame, edges: DataFrame, key: str = "") -> DataFrame:
    """One row: the number of edges between languages."""
    return joins.cross_language(edges, nodes).agg(F.count(F.lit(1)).alias("total_cross_language_edges"))


PATTERNS: dict[str, Rows] = {
    "callers_of": callers_of, "callees_of": callees_of, "imports_of": imports_of, "importers_of": importers_of, "children_of": children_of,
    "tests_for": lambda n, e, k: tests_for(n, e, k, k.split("::")[-1]), "inheritors_of": inheritors_of, "file_summary": file_summary,
    "references_to": references_to, "cross_language": cross_language_count,
}
#: Kinds and direction of the edges that a pattern returns beside its rows.
PATTERN_EDGES = {
    "callers_of": ("in", ["CALLS"]), "callees_of": ("out", ["CALLS"]), "imports_of": ("out", ["IMPORTS", "IMPORTS_FROM"]), "importers_of": ("in", ["IMPORTS", "IMPORTS_FROM"]),
    "inheritors_of": ("in", ["INHERITS", "IMPLEMENTS"]), "references_to": ("in", REFERRING),
}


def pattern_edges(edges: DataFrame, nodes: DataFrame, pattern: str, key: str) -> DataFrame:
    """The edges that a pattern returns; none for those that return rows alone."""
    if pattern == "cross_language":
        return joins.cross_language(edges, nodes).select(edges.columns)
    if pattern not in PATTERN_EDGES:
        return edges.limit(0)
    way, kinds = PATTERN_EDGES[pattern]
    return (lookup.edges_to if way == "in" else lookup.edges_from)(edges, key, kinds)


def resolve_target(nodes: DataFrame, target: str, root: str = "") -> tuple[str, list]:
    """('ok', [row]), ('ambiguous', rows) or ('not_found', []): the exact key, the key under the root, then a search."""
    for key in dict.fromkeys((target, f"{root}/{target}" if root else target)):
        found = lookup.node(nodes, key).limit(1).collect()
        if found:
            return "ok", found
    found = lookup.search(nodes, target, 5).collect()
    return ("ok" if len(found) == 1 else "ambiguous" if found else "not_found"), found
