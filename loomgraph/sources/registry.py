"""Parsers by file extension, and the pass that turns a table of files into rows of the graph."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import suffix
from loomgraph.operators.schema import EDGE_DDL, NODE_DDL
from loomgraph.sources.hcl_code import parse_hcl
from loomgraph.sources.jinja_code import parse_jinja
from loomgraph.sources.python_code import parse_python
from loomgraph.sources.rows import FileRows
from loomgraph.sources.yaml_code import parse_yaml

Parser = Callable[[str, bytes], FileRows]
PARSERS: dict[str, Parser] = {
    ".py": parse_python, ".tf": parse_hcl, ".tfvars": parse_hcl, ".yaml": parse_yaml, ".yml": parse_yaml, ".j2": parse_jinja, ".jinja2": parse_jinja, ".jinja": parse_jinja,
}
LANGUAGES = {"python": (".py",), "hcl": (".tf", ".tfvars"), "yaml": (".yaml", ".yml"), "jinja2": (".j2", ".jinja2", ".jinja")}

_NODE = [f.split() for f in NODE_DDL.split(", ")]
_EDGE = [f.split() for f in EDGE_DDL.split(", ")] + [["probe", "string"], ["found", "string"]]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
#: One row for each file; ``error`` is null where it was parsed.
PARSED_DDL = f"file_path string, file_hash string, nodes array<struct<{', '.join(f'{n}: {t}' for n, t in _NODE)}>>, edges array<struct<{', '.join(f'{n}: {t}' for n, t in _EDGE)}>>, error string"
_ARROW = pa.schema(
    [
        ("file_path", pa.string()), ("file_hash", pa.string()), ("nodes", pa.list_(pa.struct([(n, _KINDS[t]) for n, t in _NODE]))),
        ("edges", pa.list_(pa.struct([(n, _KINDS[t]) for n, t in _EDGE]))), ("error", pa.string()),
    ]
)
#: Room for the rows of one partition in the numbers that keep their order.
_PARTITION_ROWS = 1 << 40
#: Nodes and edges of files that are sent on together, about.
_BATCH_ROWS = 10_000


def register_parser(extensions: Iterable[str], parser: Parser, language: str | None = None) -> None:
    """Parse files of the given extensions with ``parser``; a later registration takes the place of an earlier one."""
    extensions = tuple(e.lower() for e in extensions)
    PARSERS.update(dict.fromkeys(extensions, parser))
    if language:
        LANGUAGES[language] = extensions


def extension(path: str) -> str:
    """The lower-cased extension of a path; empty for dotfiles."""
    base = path.rsplit("/", 1)[-1].lstrip(".")
    return "." + base.rsplit(".", 1)[1].lower() if "." in base and not base.endswith(".") else ""


def detect_language(path: str) -> str | None:
    """The language of a file by its extension."""
    return next((name for name, ends in LANGUAGES.items() if extension(path) in ends), None)


def is_supported(path: Column) -> Column:
    """True for paths with a parser."""
    return suffix(path).isin(sorted(PARSERS))


def parse_file(path: str, content: bytes) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """(nodes, edges) of one file; none without a parser."""
    parser = PARSERS.get(extension(path))
    rows = parser(path, content) if parser else FileRows(path, "")
    return rows.nodes, rows.edges


def parse_files(files: DataFrame, base: int = 0, arguments: bool = False) -> DataFrame:
    """A row (``PARSED_DDL``) for each of ``files`` (file_path, content).

    ``ord`` of nodes and edges follows the path and the order within a file, from ``base`` on. A file of which the parser fails has
    its error and no rows. Files without a parser have neither. With ``arguments``, calls of Python files keep their first string argument.
    """
    parsers = {k: partial(p, arguments=True) if arguments and p is parse_python else p for k, p in PARSERS.items()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, size = base + TaskContext.get().partitionId() * _PARTITION_ROWS, 0
        held: list[dict[str, Any]] = []
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: dict[str, Any] = {"file_path": path, "file_hash": hashlib.sha256(content).hexdigest(), "nodes": [], "edges": [], "error": None}
                parser = parsers.get(extension(path))
                try:
                    rows = parser(path, content) if parser else FileRows(path, "")
                    for n in rows.nodes:
                        n |= {"file_hash": out["file_hash"], "ord": at}
                        at += 1
                    for e in rows.edges:
                        e["ord"] = at
                        at += 1
                    out |= {"nodes": rows.nodes, "edges": rows.edges}
                except Exception as e:  # one bad file is an entry in the result, as a parser may be anyone's
                    out["error"] = f"{type(e).__name__}: {e}"
                held.append(out)
                size += len(out["nodes"]) + len(out["edges"])
                if len(held) == 256 or size > _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a number given, as adaptive execution would join small files to one task
    ordered = files.select("file_path", "content").filter("file_path IS NOT NULL AND content IS NOT NULL").repartitionByRange(tasks, "file_path").sortWithinPartitions("file_path")
    return ordered.mapInArrow(run, PARSED_DDL)


def numbered(parsed: DataFrame, first: int) -> tuple[DataFrame, int]:
    """(``parsed`` with numbers without gaps from ``first`` on, the next free number); ``parsed`` is staged, with ``base`` 0."""
    rank = F.coalesce(F.get("nodes", F.lit(0)).getField("ord"), F.get("edges", F.lit(0)).getField("ord"))
    parts = parsed.withColumn("_part", F.floor(rank / _PARTITION_ROWS).cast("int"))
    sums = parts.filter("_part IS NOT NULL").groupBy("_part").agg(F.sum(F.size("nodes") + F.size("edges")).alias("n")).orderBy("_part").collect()
    offsets = []
    for r in sums:  # a row for each task that parsed
        offsets.append((r["_part"], first - r["_part"] * _PARTITION_ROWS))
        first += r["n"]
    if not offsets:
        return parsed, first
    joined = parts.join(F.broadcast(parsed.sparkSession.createDataFrame(offsets, "_part int, _offset long")), "_part", "left")
    moved = [F.transform(c, lambda x: x.withField("ord", x.getField("ord") + F.col("_offset"))).alias(c) if c in ("nodes", "edges") else F.col(c) for c in parsed.columns]
    return joined.select(moved), first


def parsed_nodes(parsed: DataFrame) -> DataFrame:
    """The nodes of parsed files."""
    return parsed.select(F.explode("nodes").alias("n")).select("n.*")


def parsed_edges(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """The edges of parsed files; a local module's edge leads to its main file if that is among ``known`` (file_path)."""
    edges = parsed.select(F.explode("edges").alias("e")).select("e.*")
    plain = [f[0] for f in _EDGE[:-2]]
    probes = edges.filter("probe IS NOT NULL").join(known.select(F.col("file_path").alias("probe"), F.lit(True).alias("_there")).distinct(), "probe", "left")
    probed = probes.withColumn("target_qualified", F.when(F.col("_there"), F.col("found")).otherwise(F.col("target_qualified")))
    return edges.filter("probe IS NULL").select(plain).unionByName(probed.select(plain))
