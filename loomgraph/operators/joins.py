"""Joins of edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import base_name

DEPENDENT_KINDS = "CALLS IMPORTS IMPORTS_FROM INHERITS READS_CONFIG REFERENCES RENDERS".split()


def cross_language(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends have different languages, with both of them."""
    ends = nodes.filter((F.col("language").isNotNull()) & (F.col("language") != "")).select("qualified_name", "language")
    a = ends.select(F.col("qualified_name").alias("source_qualified"), F.col("language").alias("source_language"))
    b = ends.select(F.col("qualified_name").alias("target_qualified"), F.col("language").alias("target_language"))
    return edges.join(a, "source_qualified").join(b, "target_qualified").filter("source_language <> target_language")


def sources_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node at the source of each edge; edges without one drop out."""
    return nodes.join(edges.select(F.col("source_qualified").alias("qualified_name")), "qualified_name")


def targets_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node at the target of each edge; edges without one drop out."""
    return nodes.join(edges.select(F.col("target_qualified").alias("qualified_name")), "qualified_name")


def found_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each target, once."""
    return nodes.join(edges.select(F.col("target_qualified").alias("qualified_name")), "qualified_name", "left_semi")


def within_files(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(source_qualified, target_qualified): nodes of some kinds with the File node of their file."""
    files = nodes.filter("kind = 'File'").select("file_path", F.col("qualified_name").alias("target_qualified"))
    return nodes.filter(F.col("kind").isin(kinds)).join(files, "file_path").select(F.col("qualified_name").alias("source_qualified"), "target_qualified")


def edges_among(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends in ``names`` (qualified_name)."""
    a = names.select(F.col("qualified_name").alias("source_qualified"))
    b = names.select(F.col("qualified_name").alias("target_qualified"))
    return edges.join(a, "source_qualified", "left_semi").join(b, "target_qualified", "left_semi")


def subgraph_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges out of each name, as often as the name is given, into the given set."""
    a = names.select(F.col("qualified_name").alias("source_qualified"))
    b = names.select(F.col("qualified_name").alias("target_qualified"))
    return edges.join(a, "source_qualified").join(b, "target_qualified", "left_semi").select(edges.columns)


def files_by_name(nodes: DataFrame) -> DataFrame:
    """(base, target) of files: of files with one base name the last by ``ord``."""
    files = nodes.filter("kind = 'File'").select(base_name(F.col("file_path")).alias("base"), F.col("qualified_name"), F.col("ord"))
    return files.groupBy("base").agg(F.max_by("qualified_name", "ord").alias("target"))


def resolve_refs(refs: DataFrame, nodes: DataFrame, column: str = "ref") -> DataFrame:
    """``refs`` with the file that ``column`` names, by base name; unknown ones drop out."""
    return refs.withColumn("base", base_name(F.col(column))).join(files_by_name(nodes), "base").drop("base")


def file_dependents(edges: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Other files with an edge that imports a file or depends on a node of it."""
    imports = edges.filter((F.col("target_qualified") == path) & F.col("kind").isin("IMPORTS", "IMPORTS_FROM"))
    inside = nodes.filter(F.col("file_path") == path).select(F.col("qualified_name").alias("target_qualified"))
    uses = edges.filter(F.col("kind").isin(DEPENDENT_KINDS)).join(inside, "target_qualified", "left_semi").select(edges.columns)
    return imports.unionByName(uses).select("file_path").distinct().filter(F.col("file_path") != path)


def dependents(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path) of files that depend on another one of ``changed`` (file_path); ``file_dependents`` for many."""
    files = changed.select(F.col("file_path").alias("_of")).distinct()
    imports = edges.filter(F.col("kind").isin("IMPORTS", "IMPORTS_FROM")).join(files, F.col("target_qualified") == F.col("_of"))
    inside = nodes.join(files, F.col("file_path") == F.col("_of")).select(F.col("qualified_name").alias("target_qualified"), "_of")
    uses = edges.filter(F.col("kind").isin(DEPENDENT_KINDS)).join(inside, "target_qualified")
    return imports.select("file_path", "_of").unionByName(uses.select("file_path", "_of")).filter("file_path <> _of").select("file_path").distinct()


def first_per(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The first row by ``ord``, or by the given columns, for each key."""
    w = Window.partitionBy(*keys).orderBy(*(order or ["ord"]))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
