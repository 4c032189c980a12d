"""Counts over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_rows(rows: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"))


def by_kind(rows: DataFrame) -> DataFrame:
    """Rows of each kind."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def languages(nodes: DataFrame) -> DataFrame:
    """The languages there are."""
    return nodes.filter("language <> ''").select("language").distinct()


def files(nodes: DataFrame) -> DataFrame:
    """The files there are."""
    return nodes.filter("kind = 'File'").select("file_path").distinct()


def files_count(nodes: DataFrame) -> DataFrame:
    """One row with the number of files."""
    return nodes.agg(F.count_if(F.col("kind") == "File").alias("files_count"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files with nodes, their nodes and edges."""
    a, b = (rows.groupBy("file_path").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((nodes, "nodes"), (edges, "edges")))
    return a.join(b, "file_path", "left").agg(F.count(F.lit(1)).alias("files"), F.sum("nodes").alias("nodes"), F.sum(F.coalesce("edges", F.lit(0))).alias("edges"))


def names_of(nodes: DataFrame, kind: str) -> DataFrame:
    """(name, keys) of the nodes of a kind: the keys that have the name, sorted."""
    return nodes.filter(F.col("kind") == kind).groupBy("name").agg(F.array_sort(F.collect_set("qualified_name")).alias("keys"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, counts by kind as maps, sorted languages, number of files."""
    def side(rows: DataFrame, total: str, kinds: str, *more) -> DataFrame:  # type: ignore[no-untyped-def]
        counted = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[m for m, _ in more])
        return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(total), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias(kinds), *[m for _, m in more])

    spoken = F.collect_set(F.when(F.col("language") != "", F.col("language"))).alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("languages")
    n = side(nodes, "total_nodes", "nodes_by_kind", spoken, (F.count_if(F.col("kind") == "File").alias("f"), F.coalesce(F.sum("f"), F.lit(0)).alias("files_count")))
    return n.crossJoin(side(edges, "total_edges", "edges_by_kind"))
