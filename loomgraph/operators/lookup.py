"""Filters and lookups on nodes and edges."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import like_word

Text = str | None


def node(nodes: DataFrame, key: str) -> DataFrame:
    """The node with a key."""
    return nodes.filter(F.col("qualified_name") == key)


def nodes_of_file(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes of a file."""
    return nodes.filter(F.col("file_path") == path)


def nodes_of_language(nodes: DataFrame, language: str) -> DataFrame:
    """The nodes of a language."""
    return nodes.filter(F.col("language") == language)


def with_language(nodes: DataFrame) -> DataFrame:
    """The nodes that have a language."""
    return nodes.filter(F.col("language").isNotNull() & (F.col("language") != ""))


def edges_from(edges: DataFrame, key: str, kinds: Iterable[str] = ()) -> DataFrame:
    """The edges out of a node, of some kinds or of all."""
    return of_kinds(edges.filter(F.col("source_qualified") == key), kinds)


def edges_to(edges: DataFrame, key: str, kinds: Iterable[str] = ()) -> DataFrame:
    """The edges into a node, of some kinds or of all."""
    return of_kinds(edges.filter(F.col("target_qualified") == key), kinds)


def of_kinds(rows: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Rows of some kinds; all without a kind given."""
    kinds = list(kinds)
    return rows.filter(F.col("kind").isin(kinds)) if kinds else rows


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first nodes, by ``ord``, of which name or key holds every word of the query; none for an empty query."""
    words = query.lower().split()
    if not words:
        return nodes.limit(0)
    match = reduce(lambda a, b: a & b, [like_word(F.col("name"), w) | like_word(F.col("qualified_name"), w) for w in words])
    return nodes.filter(match).orderBy("ord").limit(limit)


def search_filtered(nodes: DataFrame, query: str, kind: Text = None, language: Text = None, limit: int = 20) -> DataFrame:
    """``search`` for twice the limit, then kind and language, then the limit: the filters come after the first cut."""
    found = search(nodes, query, limit * 2)
    if kind:
        found = found.filter(F.col("kind") == kind)
    if language:
        found = found.filter(F.col("language") == language)
    return found.orderBy("ord").limit(limit)
