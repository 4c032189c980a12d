"""The public interface: build, impact, named queries, search, statistics and review context, as plain dictionaries.

Each function takes a repository's root or the name of a group from the settings. Results are what a caller shows, so they are
collected; for results of any size, use the DataFrames of ``loomgraph.operators``.
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import decoded, numbered, sanitize
from loomgraph.operators import ingest, lookup, patterns, stats, traverse
from loomgraph.operators.store import GraphStore, to_json_rows
from loomgraph.sources import files as sources
from loomgraph.sources.config import Config

Text = str | None
Names = list[str] | None
Settings = Config | None
#: What each named query finds.
QUERIES = {
    "callers_of": "The functions that call a function", "callees_of": "The functions that a function calls", "imports_of": "What a file or module imports", "importers_of": "The files that import a file or module",
    "children_of": "What a file or class contains", "tests_for": "The tests of a function or class", "inheritors_of": "The classes that inherit from a class", "file_summary": "The nodes of a file",
    "references_to": "What refers to a resource, variable or module", "cross_language": "The edges between languages",
}
#: Queries that need no node.
TARGETLESS = frozenset(("cross_language", "file_summary"))
NODE_FIELDS = ["kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "is_test"]
EDGE_FIELDS = ["kind", "source_qualified", "target_qualified", "file_path", "line"]
#: Nodes that a review context reaches at most.
REVIEW_NODES = 500


def told(summary: str, status: str = "ok", **more: Any) -> dict[str, Any]:
    """A result as all functions give it."""
    return dict(status=status, summary=summary, **more)


def node_rows(nodes: DataFrame) -> list[dict[str, Any]]:
    """Nodes as dictionaries, names and keys cleaned of control characters."""
    clean = {c: sanitize(F.col(c)).alias(c) for c in ("name", "qualified_name", "parent_name")}
    return to_json_rows(nodes.select(*[clean.get(c, F.col(c)) for c in NODE_FIELDS]))


def edge_rows(edges: DataFrame) -> list[dict[str, Any]]:
    """Edges as dictionaries."""
    return to_json_rows(edges.select(EDGE_FIELDS))


def open_store(spark: SparkSession, repo_root: Text = None, group: Text = None, config: Settings = None) -> tuple[GraphStore, str, list[str]]:
    """(store, root, repositories) of a group, or of a repository; relative names are looked up under the first root."""
    config = config or Config()
    if group:
        at = config.group_db(group)
        if at is None:
            raise ValueError(f"no group {group!r}; there are {config.list_groups()}")
        repos = [r for r in config.group_repos(group) if os.path.isdir(r)]
        return GraphStore(spark, at), repos[0] if repos else "", repos
    root = os.path.realpath(repo_root) if repo_root else sources.project_root()
    if repo_root and not os.path.isdir(root):
        raise ValueError(f"not a folder: {root}")
    if repo_root and not any(os.path.exists(f"{root}/{mark}") for mark in (".git", ".loomgraph")):
        raise ValueError(f"neither .git nor .loomgraph in {root}")
    mine = config.group_of(root)
    if config.db_of(root).startswith(f"{root}/.loomgraph/") and not os.path.exists(mark := f"{root}/.loomgraph/.gitignore"):
        os.makedirs(f"{root}/.loomgraph", exist_ok=True)
        with open(mark, "w") as f:
            f.write("*\n")
    return GraphStore(spark, config.db_of(root)), root, [r for r in config.group_repos(mine) if os.path.isdir(r)] if mine else [root]


def _build_many(store: GraphStore, repos: list[str], link: bool) -> dict[str, Any]:
    made = ingest.build_roots(store, repos, link)
    summary = f"{len(repos)} repositories: {made['files_parsed']} files, {made['total_nodes']} nodes, {made['total_edges']} edges, {made['cross_ref_edges']} of them across files"
    return told(summary, build_type="full_group", repos_built=len(repos), **made)


def build_or_update_graph(spark: SparkSession, full_rebuild: bool = False, repo_root: Text = None, base: str = "HEAD~1", group: Text = None, config: Settings = None, link: bool = False) -> dict[str, Any]:
    """Build the whole graph of a repository or group, or bring it up to date with what changed since ``base``. A group is always built whole; see ``ingest.build_roots`` for ``link``."""
    store, root, repos = open_store(spark, repo_root, group, config)
    if group or (full_rebuild and len(repos) > 1):
        return _build_many(store, repos, link)
    if full_rebuild:
        made = ingest.full_build(store, root, link)
        return told(f"{made['files_parsed']} files, {made['total_nodes']} nodes, {made['total_edges']} edges, {made['cross_ref_edges']} of them across files", build_type="full", **made)
    made = ingest.incremental_update(store, root, base)
    summary = f"{made['files_updated']} files brought up to date: {made['total_nodes']} nodes, {made['total_edges']} edges" if made["files_updated"] else "Nothing has changed."
    return told(summary, build_type="incremental", **made)


def _changed(root: str, given: list[str] | None, base: str) -> list[str]:
    return given if given is not None else sources.changed_since(root, base) or sources.uncommitted(root)


def _impact(spark: SparkSession, store: GraphStore, root: str, changed: list[str], depth: int, most: int) -> traverse.Impact:
    return traverse.impact(store.nodes, store.edges, spark.createDataFrame([(f"{root}/{c}",) for c in changed], "file_path string"), depth, most)


def get_impact_radius(
    spark: SparkSession, changed_files: Names = None, max_results: int = 500, max_depth: int = 2, base: str = "HEAD~1", group: Text = None, repo_root: Text = None, config: Settings = None
) -> dict[str, Any]:
    """What a change of files reaches within some hops; without files given, what differs from ``base`` or isn't committed."""
    store, root, _ = open_store(spark, repo_root, group, config)
    changed = _changed(root, changed_files, base)
    if not changed:
        return told("No file has changed.", **{k: [] for k in ("changed_nodes", "impacted_files", "impacted_nodes")})
    found = _impact(spark, store, root, changed, max_depth, max_results)
    start, reached, files = node_rows(found.changed), node_rows(found.nodes), [r["file_path"] for r in found.files.collect()]
    summary = f"{len(changed)} changed files: {len(start)} nodes in them, {len(reached)} nodes within {max_depth} hops, {len(files)} files reached"
    return told(summary, changed_files=changed, changed_nodes=start, impacted_nodes=reached, impacted_files=files, edges=edge_rows(found.edges))


def query_graph(spark: SparkSession, pattern: str, target: str = "", repo_root: Text = None, group: Text = None, config: Settings = None) -> dict[str, Any]:
    """A named query on a node: its key, its key under the root, or words that only it has."""
    if pattern not in QUERIES:
        return dict(status="error", error=f"no query {pattern!r}; there are {list(QUERIES)}")
    store, root, _ = open_store(spark, repo_root, group, config)
    nodes, edges = store.nodes, store.edges
    state, found = patterns.resolve_target(nodes, target, root) if target else ("not_found", [])
    if state == "ambiguous":
        rows = node_rows(nodes.join(spark.createDataFrame([(r["qualified_name"],) for r in found], "qualified_name string"), "qualified_name", "left_semi"))
        return told(f"{target!r} fits several nodes; give a key.", "ambiguous", candidates=rows)
    if state == "not_found" and pattern not in TARGETLESS:
        return told(f"No node fits {target!r}.", state)
    node = found[0] if found else None
    if node is not None and target not in (node["qualified_name"], node["qualified_name"].removeprefix(f"{root}/")):
        target = node["qualified_name"]  # a search led there
    key = node["qualified_name"] if node is not None else target
    if pattern == "file_summary":
        key = target if target.startswith("/") or "://" in target else f"{root}/{target}"
    elif pattern == "importers_of" and node is not None:
        key = node["file_path"]
    rows = patterns.tests_for(nodes, edges, key, node["name"]) if pattern == "tests_for" and node is not None else patterns.PATTERNS[pattern](nodes, edges, key)
    results = node_rows(rows) if "qualified_name" in rows.columns else to_json_rows(rows)
    links = edge_rows(patterns.pattern_edges(edges, nodes, pattern, key))
    return told(f"{pattern}({target!r}): {len(results)} results", pattern=pattern, target=target, description=QUERIES[pattern], results=results, edges=links)


def search_nodes(spark: SparkSession, query: str, kind: Text = None, language: Text = None, limit: int = 20, repo_root: Text = None, group: Text = None, config: Settings = None) -> dict[str, Any]:
    """Nodes of which name or key holds every word; kind and language are looked at after the first twice ``limit`` finds."""
    store, _, _ = open_store(spark, repo_root, group, config)
    rows = node_rows(lookup.search_filtered(store.nodes, query, kind, language, limit))
    return told(f"{len(rows)} nodes fit {query!r}" + f", kind {kind}" * bool(kind) + f", language {language}" * bool(language), query=query, results=rows)


def list_graph_stats(spark: SparkSession, repo_root: Text = None, group: Text = None, config: Settings = None) -> dict[str, Any]:
    """Totals of a graph, by kind, with its languages and the time of its last build."""
    store, root, _ = open_store(spark, repo_root, group, config)
    row = stats.graph_stats(store.nodes, store.edges).first().asDict()
    row["last_updated"] = store.get_metadata("last_updated")
    of = group or os.path.basename(root)
    lines = [f"{of}: {row['files_count']} files, {row['total_nodes']} nodes, {row['total_edges']} edges", f"languages: {', '.join(row['languages']) or 'none'}", f"last build: {row['last_updated'] or 'never'}"]
    lines += [f"{side} of kind {k}: {n}" for side, kinds in (("nodes", row["nodes_by_kind"]), ("edges", row["edges_by_kind"])) for k, n in sorted(kinds.items())]
    return told("\n".join(lines), **row)


def review_snippets(spark: SparkSession, root: str, names: list[str], most_lines: int = 200) -> dict[str, str]:
    """The first lines of files, numbered; files that are gone have none."""
    there = [n for n in names if os.path.isfile(f"{root}/{n}")]
    paths = spark.createDataFrame([(f"{root}/{n}",) for n in there], "file_path string")
    text = F.when(F.col("content").isNull(), "(unreadable)").otherwise(numbered(decoded(F.col("content")), most_lines))
    return {r["file_path"].removeprefix(f"{root}/"): r["t"] for r in sources.read_contents(paths).select("file_path", text.alias("t")).collect()}


def get_review_context(
    spark: SparkSession, changed_files: Names = None, max_depth: int = 2, include_source: bool = True, max_lines_per_file: int = 200, repo_root: Text = None, base: str = "HEAD~1", group: Text = None,
    config: Settings = None,
) -> dict[str, Any]:
    """What a reviewer of changed files wants to see: what they reach, and their own numbered lines."""
    store, root, _ = open_store(spark, repo_root, group, config)
    changed = _changed(root, changed_files, base)
    if not changed:
        return told("No file has changed.", context={})
    found = _impact(spark, store, root, changed, max_depth, REVIEW_NODES)
    reached = node_rows(found.nodes)
    context: dict[str, Any] = {"changed_files": changed, "impacted_files": [r["file_path"] for r in found.files.collect()], "graph": {"changed_nodes": node_rows(found.changed), "impacted_nodes": reached, "edges": edge_rows(found.edges)}}
    if include_source:
        context["source_snippets"] = review_snippets(spark, root, changed, max_lines_per_file)
    return told(f"{len(changed)} changed files reach {len(reached)} nodes", context=context)
