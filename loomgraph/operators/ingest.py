"""Builds of the graph: whole repositories, groups of them, and what changed.

A build parses every file once, in parallel, into a staged table; then the rows of the files replace those in the store, and edges across files are
looked for in the whole store. One snapshot is written, so a build that fails leaves the store as it was.
"""

from __future__ import annotations

import time
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import joins, store as stores, xref
from loomgraph.operators.store import GraphStore
from loomgraph.operators.tables import staged
from loomgraph.sources import files as sources
from loomgraph.sources.registry import numbered, parse_files, parsed_edges, parsed_nodes

def _totals(parsed: DataFrame) -> tuple[int, int, int]:
    """(files, nodes, edges) as emitted, before equal rows are merged."""
    row = parsed.filter("error IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("nodes")), F.lit(0)), F.coalesce(F.sum(F.size("edges")), F.lit(0))).first()
    return row[0], row[1], row[2]


def _errors(parsed: DataFrame, root: str) -> list[dict[str, str]]:
    rows = parsed.filter("error IS NOT NULL").select("file_path", "error").orderBy("file_path").collect()
    return [{"file": r["file_path"].removeprefix(root.rstrip("/") + "/"), "error": r["error"]} for r in rows]


def _stamp(kind: str) -> dict[str, str]:
    return {"last_updated": time.strftime("%Y-%m-%dT%H:%M:%S"), "last_build_type": kind}


def build_roots(store: GraphStore, roots: list[str], link: bool = False) -> dict[str, Any]:
    """Build all files under some roots into a store, and find edges across files once.

    Files under the roots that aren't there any more leave the store. A file that fails keeps the rows of its last build.
    With ``link``, calls and bases of Python files lead to the symbols of their file that they name, and calls with names of YAML and template files to these.
    """
    roots = [r.rstrip("/") for r in roots]
    if not roots:
        return {"files_parsed": 0, "total_nodes": 0, "total_edges": 0, "cross_ref_edges": 0, "errors": []}
    return build_files(store, reduce(DataFrame.unionByName, [sources.source_files(store.spark, r) for r in roots]), roots, link)


def build_files(store: GraphStore, files: DataFrame, roots: list[str], link: bool = False) -> dict[str, Any]:
    """``build_roots`` with the table of files (file_path, content) given, the whole of what is under the roots."""
    first = store.begin()
    parsed, following = numbered(staged(parse_files(files.dropDuplicates(["file_path"]), arguments=link), "parsed"), first)
    current = parsed.select("file_path")
    gone = reduce(DataFrame.unionByName, [stores.stale_files(store.nodes, current, r) for r in roots])
    replaced = parsed.filter("error IS NULL").select("file_path").unionByName(gone).distinct()
    nodes = staged(stores.replace_files(store.nodes, replaced, stores.upsert_nodes(parsed_nodes(parsed))), "nodes")
    edges = staged(stores.replace_files(store.edges, replaced, stores.upsert_edges(parsed_edges(parsed, current))), "edges")
    if link:
        edges, found = xref.linked(nodes, edges)
        edges = staged(stores.upsert_edges(edges), "edges")
    else:
        found = xref.detect(nodes, edges)
    across = staged(found, "across")
    n_across, (_, n_nodes, n_edges) = across.count(), _totals(parsed)
    store.commit(nodes, stores.upsert_edges(edges.unionByName(across)) if n_across else edges, _stamp("full"), following, unique=True)
    return {"files_parsed": parsed.count(), "total_nodes": n_nodes, "total_edges": n_edges + n_across, "cross_ref_edges": n_across, "errors": _errors(parsed, roots[0] if len(roots) == 1 else "")}


def full_build(store: GraphStore, root: str, link: bool = False) -> dict[str, Any]:
    """``build_roots`` of one repository."""
    return build_roots(store, [root], link)


def replace_parsed(store: GraphStore, parsed: DataFrame, removed: DataFrame, kind: str, first: int) -> tuple[int, int]:
    """Put the rows of parsed files in place of what the store has of them, and take removed files out; (nodes, edges) as emitted. Numbers begin at ``first``."""
    parsed, following = numbered(parsed, first)
    paths = parsed.filter("error IS NULL").select("file_path").unionByName(removed.select("file_path"))
    known = store.nodes.filter("kind = 'File'").select("file_path").unionByName(parsed.select("file_path")).join(removed.select("file_path"), "file_path", "left_anti")
    store.replace(paths, parsed_nodes(parsed), parsed_edges(parsed, known), _stamp(kind), following)
    return _totals(parsed)[1:]


def unstored(files: DataFrame, store: GraphStore) -> DataFrame:
    """Files (file_path, content) of which the store hasn't got the content."""
    stored = store.nodes_of(files).groupBy("file_path").agg(F.min_by("file_hash", "ord").alias("file_hash"))
    return files.withColumn("file_hash", F.sha2("content", 256)).join(stored, ["file_path", "file_hash"], "left_anti").select("file_path", "content")


def incremental_update(store: GraphStore, root: str, base: str = "HEAD~1", changed: list[str] | None = None) -> dict[str, Any]:
    """Bring changed files of a repository up to date, and files that depend on them as far as their content differs.

    Files that are gone leave the store; files of equal content are left alone; binary ones are parsed if they are named. Edges across files aren't looked for again: those that began in
    a file that was replaced are gone until the next build.
    """
    spark, root = store.spark, root.rstrip("/")
    first = store.begin()
    changed = sources.changed_since(root, base) if changed is None else changed
    if not changed:
        return dict.fromkeys(("files_updated", "total_nodes", "total_edges"), 0) | {k: [] for k in ("errors", "dependent_files", "changed_files")}
    table = spark.createDataFrame([(f"{root}/{c}",) for c in changed], "file_path string")
    dependent = sorted(r["file_path"].removeprefix(root + "/") for r in joins.dependents(store.edges, store.nodes, table).collect())
    names = sorted({*changed, *dependent})
    wanted = sources.paths_table(spark, root, names)
    contents = staged(sources.read_contents(wanted), "contents")
    patterns = sources.ignore_patterns(root) if "://" not in root else sources.IGNORED
    unignored = spark.createDataFrame([(f"{root}/{n}", n) for n in names], "file_path string, name string").filter(~sources.matches_any(F.col("name"), patterns))
    gone = sources.read_contents(unignored).filter("content IS NULL").select("file_path")
    removed = staged(gone, "removed")
    parsed = staged(parse_files(unstored(contents.filter("content IS NOT NULL"), store)), "parsed")
    nodes, edges = replace_parsed(store, parsed, removed, "incremental", first)
    return {"files_updated": len(names), "total_nodes": nodes, "total_edges": edges, "changed_files": list(changed), "dependent_files": dependent, "errors": _errors(parsed, root)}
