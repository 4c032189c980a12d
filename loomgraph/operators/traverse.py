"""Bounded traversal: what a change of some files reaches."""

from __future__ import annotations

from contextlib import AbstractContextManager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.joins import edges_among
from loomgraph.operators.schema import DEPENDENCY_KINDS
from loomgraph.operators.tables import grouped, settings, staged


def adjacency(edges: DataFrame) -> DataFrame:
    """(source_qualified, target_qualified, kind): parallel edges as one, of the kind of the last by ``ord``."""
    return grouped(edges, "source_qualified", "target_qualified").agg(F.max_by("kind", "ord").alias("kind")).drop("_hash")


def marked_links(edges: DataFrame) -> DataFrame:
    """(a, b, _m): the ends of each edge; order and the mark of a kind along which changes spread are one number, so they are grouped by hash."""
    return edges.select(F.col("source_qualified").alias("a"), F.col("target_qualified").alias("b"), (F.col("ord") * 2 + F.col("kind").isin(DEPENDENCY_KINDS).cast("long")).alias("_m"))


def neighbours(links: DataFrame, names: DataFrame) -> DataFrame:
    """(qualified_name) beside ``names`` (qualified_name), in both directions, along edges of a spreading kind, after parallel ones were merged: the kind of the last by ``ord`` counts.

    All parallel edges touch the same names, so only edges that touch some are merged. ``links`` are ``marked_links``.
    """
    out, into = (links.join(names.select(F.col("qualified_name").alias(end)), end, "left_semi").select("a", "b", F.lit(far).alias("_far"), "_m") for end, far in (("a", "b"), ("b", "a")))
    strong = out.unionByName(into).groupBy("a", "b", "_far").agg(F.max("_m").alias("_m")).filter("_m % 2 = 1 AND a <> b")
    return strong.select(F.when(F.col("_far") == "b", F.col("b")).otherwise(F.col("a")).alias("qualified_name")).distinct()


def _sifted(spark: SparkSession, names: int) -> AbstractContextManager[None]:
    """Joins with a selection of so many names sift the other side by a Bloom filter of them before it is shuffled, whatever its size."""
    at = "optimizer__runtime__bloomFilter__"
    bits = min(max(names, 1000) * 16, int(spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.maxNumBits")))
    return settings(spark, **{f"{at}applicationSideScanSizeThreshold": "1", f"{at}creationSideThreshold": "1g", f"{at}expectedNumItems": str(max(names, 1000)), f"{at}numBits": str(bits)})


def seeds(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(qualified_name, depth): the nodes of the changed files (file_path), at depth 0."""
    return nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name").distinct().withColumn("depth", F.lit(0))


def levels(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3, max_nodes: int = 500) -> DataFrame:
    """(qualified_name, depth) of all names reached from the nodes of the changed files (file_path).

    Names that are no nodes are passed through. After a level that takes the names over ``max_nodes`` the walk stops; that level stays in. Each level is
    written out, so the plan doesn't grow, and looks up the names of the one before at both ends of the links; a hub is a skewed key, which Spark splits.
    """
    return _walk(nodes, staged(marked_links(edges), "links"), changed, max_depth, max_nodes)


def _walk(nodes: DataFrame, links: DataFrame, changed: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """``levels`` over staged links."""
    reached = frontier = staged(seeds(nodes, changed), "reached")
    total = n = reached.count()
    for depth in range(1, max_depth + 1):
        with _sifted(nodes.sparkSession, n):
            beside = neighbours(links, frontier.filter(F.col("depth") == depth - 1))
            frontier = staged(beside.join(reached, "qualified_name", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        n = frontier.count()
        if not n:
            break
        reached, total = reached.unionByName(frontier), total + n
        if total > max_nodes:
            break
    return reached


class Impact:
    """What a change of files reaches: ``changed`` nodes (depth 0), ``nodes`` by (depth, key) up to a number with their ``files``, ``edges`` among them and the changed nodes, ``total``, ``truncated``.

    Each is made when it is asked for; edges are staged and walked along once, for the first that needs it, and the changed nodes need no walk.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int, max_nodes: int) -> None:
        self._nodes, self._given, self._files, self._depth, self._most = nodes, edges, changed, max_depth, max_nodes

    @cached_property
    def changed(self) -> DataFrame:
        return self._nodes.join(seeds(self._nodes, self._files), "qualified_name")

    @cached_property
    def _edges(self) -> DataFrame:
        return staged(self._given, "edges")

    @cached_property
    def _found(self) -> DataFrame:
        reached = _walk(self._nodes, marked_links(self._edges), self._files, self._depth, self._most)
        return staged(self._nodes.join(reached.filter("depth > 0"), "qualified_name"), "impact")

    @cached_property
    def total(self) -> int:
        return self._found.count()

    @property
    def truncated(self) -> bool:
        return self.total > self._most

    @cached_property
    def nodes(self) -> DataFrame:
        return self._found.orderBy("depth", "qualified_name").limit(self._most) if self.truncated else self._found

    @cached_property
    def files(self) -> DataFrame:
        return self.nodes.select("file_path").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        names = self.changed.select("qualified_name").unionByName(self.nodes.select("qualified_name"))
        return edges_among(self._edges, names)


def impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3, max_nodes: int = 500) -> Impact:
    """What a change of files reaches: nodes by (depth, key) up to ``max_nodes``, their files, and the edges among them and the changed nodes."""
    return Impact(nodes, edges, changed, max_depth, max_nodes)
