"""Mutations as functions from tables to tables, and a store of snapshots in one folder.

Plain Parquet has no update in place, so each write makes a new snapshot out of new files for what it touches and the old ones for the rest.
A small pointer file names the current snapshot and is replaced in one step by a rename.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.schema import EDGE_DDL, EDGE_KEY, METADATA_DDL, NODE_DDL
from loomgraph.operators.tables import grouped

#: Buckets of a new store; for a hundred terabytes, give some thousands.
BUCKETS = 32


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row for each key, the last by ``ord``, at the place (``ord``) of the first."""
    values = [c for c in rows.columns if c not in ("qualified_name", "ord")]
    last = grouped(rows, "qualified_name").agg(F.max_by(F.struct(*values), "ord").alias("_v"), F.min("ord").alias("ord"))
    return last.select(*[F.col(c) if c in ("qualified_name", "ord") else F.col("_v").getField(c).alias(c) for c in rows.columns])


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One row for each (kind, source, target, file, line): place of the first, other values of the last."""
    values = [c for c in rows.columns if c not in (*EDGE_KEY, "ord")]
    last = grouped(rows, *EDGE_KEY).agg(*[F.max_by(c, "ord").alias(c) for c in values], F.min("ord").alias("ord"))
    return last.select(rows.columns)


def remove_files(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of other files than ``paths`` (file_path); edges go by the file that they lie in."""
    return rows.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(rows.columns)


def replace_files(rows: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """``remove_files``, then the new rows."""
    return remove_files(rows, paths).unionByName(new)


def stale_files(nodes: DataFrame, current: DataFrame, root: str) -> DataFrame:
    """(file_path) of stored files under a root that aren't there any more; a root matches whole components."""
    under = F.col("file_path").startswith(root.rstrip("/") + "/")
    return nodes.filter((F.col("kind") == "File") & under).select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, state) between two lists of (file_path, file_hash): added, changed or deleted."""
    a = old.select("file_path", F.col("file_hash").alias("_old"))
    b = new.select("file_path", F.col("file_hash").alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, "file_path", "full_outer").select("file_path", state.alias("state")).filter("state IS NOT NULL")


class ConcurrentUpdate(RuntimeError):
    """Another writer has changed the store since this one began."""


def bucket(path: Column, buckets: int) -> Column:
    """The bucket of a file's rows."""
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class GraphStore:
    """Snapshots of nodes, edges and metadata under one folder that all executors share.

    Rows lie in buckets by their file, nodes sorted by key and edges by target, so that row groups without a sought one are skipped. A snapshot is a manifest that names a
    folder for each bucket; an update writes the buckets of its files anew and shares the others with the snapshot before. A key
    belongs to one file, as keys begin with its path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self._buckets, self._began = spark, path.rstrip("/"), buckets, None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _text(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _manifest(self) -> dict:
        at = self._text("CURRENT")
        return json.loads(self._text(f"{at}.json") or "{}") if at else {"version": None, "buckets": self._buckets, "nodes": {}, "edges": {}, "metadata": {}, "next": 0}

    def begin(self) -> int:
        """Begin an update: it fails at its commit if another one comes between. Returns the first free number of the order of rows."""
        held = self._manifest()
        self._began = (held["version"],)
        return held["next"]

    def _read(self, table: str, ddl: str, only: list[int] | None = None) -> DataFrame:
        held = self._manifest()[table]
        paths = sorted(p for b, p in held.items() if only is None or int(b) in only)
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], ddl)

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes", NODE_DDL)

    @property
    def edges(self) -> DataFrame:
        return self._read("edges", EDGE_DDL)

    @property
    def metadata(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._manifest()["metadata"].items()), METADATA_DDL)

    def get_metadata(self, key: str) -> str | None:
        return self._manifest()["metadata"].get(key)

    def touched(self, paths: DataFrame) -> list[int]:
        """The buckets of some files (file_path)."""
        return sorted(r[0] for r in paths.select(bucket(F.col("file_path"), self._manifest()["buckets"])).distinct().collect())

    def nodes_of(self, paths: DataFrame) -> DataFrame:
        """The nodes of some files (file_path); only their buckets are read."""
        return self._read("nodes", NODE_DDL, self.touched(paths)).join(paths.select("file_path").distinct(), "file_path", "left_semi")

    def _write(self, rows: DataFrame, table: str, order: str, buckets: int) -> dict[str, str]:
        """Write rows in a new folder; (bucket, folder under the root) of what there is."""
        at = f"data/{table}-{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        placed = rows.withColumn("_bucket", bucket(F.col("file_path"), buckets)).repartition("_bucket").sortWithinPartitions("_bucket", order)
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/{at}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{at}"))]
        return {m.split("=")[1]: f"{at}/{m}" for m in made if m.startswith("_bucket=") and "HIVE" not in m}

    def _switch(self, held: dict, seen: str | None) -> None:
        """Make ``held`` the current snapshot if ``seen`` still is."""
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        self._put(f"{version}.json", json.dumps(held | {"version": version}))
        try:
            self._put("LOCK", version, overwrite=False)
        except Exception as e:
            raise ConcurrentUpdate(f"{self.path} is locked by another writer (a file LOCK that one left behind has to be removed)") from e
        try:
            if self._text("CURRENT") != seen:
                raise ConcurrentUpdate(f"{self.path} has changed since this update began")
            self._put(f".next-{version}", version)
            jvm = self.spark.sparkContext._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            renames = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context.rename(self._path(f"{self.path}/.next-{version}"), self._path(f"{self.path}/CURRENT"), renames)
        finally:
            self._fs.delete(self._path(f"{self.path}/LOCK"), False)
            self._began = None

    def _base(self) -> tuple[dict, str | None]:
        held = self._manifest()
        return held, self._began[0] if self._began else held["version"]

    def commit(self, nodes: DataFrame, edges: DataFrame, metadata: dict[str, str] | None = None, following: int | None = None, unique: bool = False) -> None:
        """Make the given rows the current snapshot, keys made unique unless they are; older ones stay until ``vacuum``. ``following`` is the next free number."""
        held, seen = self._base()
        nodes, edges = (nodes, edges) if unique else (upsert_nodes(nodes), upsert_edges(edges))
        new = {"nodes": self._write(nodes, "nodes", "qualified_name", held["buckets"]), "edges": self._write(edges, "edges", "target_qualified", held["buckets"])}
        self._switch(held | new | {"metadata": held["metadata"] | (metadata or {}), "next": max(held["next"], following or 0)}, seen)

    def set_metadata(self, **values: str) -> None:
        held, seen = self._base()
        self._switch(held | {"metadata": held["metadata"] | values}, seen)

    def replace(self, paths: DataFrame, nodes: DataFrame, edges: DataFrame, metadata: dict[str, str] | None = None, following: int | None = None) -> None:
        """Replace all rows of the files ``paths`` by new ones; only buckets of these files are written."""
        held, seen = self._base()
        nodes, edges = upsert_nodes(nodes), upsert_edges(edges)
        touched = self.touched(paths.select("file_path").unionByName(nodes.select("file_path")).unionByName(edges.select("file_path")))
        new = {}
        for table, ddl, rows, order in (("nodes", NODE_DDL, nodes, "qualified_name"), ("edges", EDGE_DDL, edges, "target_qualified")):
            made = self._write(replace_files(self._read(table, ddl, touched), paths, rows), table, order, held["buckets"])
            new[table] = {b: p for b, p in held[table].items() if int(b) not in touched} | made
        self._switch(held | new | {"metadata": held["metadata"] | (metadata or {}), "next": max(held["next"], following or 0)}, seen)

    def vacuum(self) -> None:
        """Remove all snapshots but the current one."""
        held, current = self._manifest(), self._text("CURRENT")
        used = {p for t in ("nodes", "edges") for p in held[t].values()}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v") and name.endswith(".json") and name != f"{current}.json":
                self._fs.delete(status.getPath(), True)
        if not self._fs.exists(self._path(f"{self.path}/data")):
            return
        for status in self._fs.listStatus(self._path(f"{self.path}/data")):
            for part in self._fs.listStatus(status.getPath()):
                if f"data/{status.getPath().getName()}/{part.getPath().getName()}" not in used:
                    self._fs.delete(part.getPath(), True)


def to_json_rows(rows: DataFrame) -> list[dict]:
    """Rows as plain dictionaries, with the names of the public interface."""
    names = {"source_qualified": "source", "target_qualified": "target"}
    return [{names.get(k, k): v for k, v in json.loads(r[0]).items()} for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]
