"""The driver's queries over source files: each parser's rows in full, and builds, updates and the public interface over a repository that is laid out on disk."""

from __future__ import annotations

import contextlib
import io
import json
import os
import subprocess
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import __main__ as command, api
from loomgraph.functions.columns import decoded, last_segment
from loomgraph.operators import ingest, lookup, patterns, xref
from loomgraph.operators.schema import EDGE_DDL
from loomgraph.operators.store import GraphStore, to_json_rows
from loomgraph.operators.tables import shared_dir, staged
from loomgraph.plans.parser_cases import CASES, Case
from loomgraph.sources import files as sources, registry
from loomgraph.sources.config import Config, write_default
from loomgraph.sources.registry import parse_files, parsed_edges, parsed_nodes
from loomgraph.sources.rows import FileRows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(rows: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = rows, sql
        return rows

    return add


# Parsers: one file of each kind for every supplier, with all that its rows hold.
_NODE = ["kind", "name", "qualified_name", "line_start", "line_end", "parent_name", "params", "return_type", "modifiers", "is_test", "extra"]
_EDGE = ["kind", "source_qualified", "target_qualified", "line", "extra"]


def _case_files(spark: SparkSession, sf_dir: str, case: Case) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("/c/"), key, F.lit(f"/{case.file}")).alias("file_path"), F.encode(F.replace(F.lit(case.text), F.lit("{k}"), key), "UTF-8").alias("content"))


def _parsed(files: DataFrame) -> DataFrame:
    """Files parsed once, as in a build: more than one branch of a query reads them."""
    return staged(parse_files(files), "parsed")


def _case_sql(case: Case, columns: list[str], rows: list[tuple]) -> str:
    def value(x: Any) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()

    def filled(c: str, x: Any) -> str:
        return f"replace(replace({c}, '{{p}}', '/c/' || s_suppkey || '/{case.file}'), '{{k}}', s_suppkey::VARCHAR) AS {c}" if isinstance(x, str) else f"{c}::{'BOOLEAN' if isinstance(x, bool) else 'INT'} AS {c}"

    names = ", ".join(filled(c, x) for c, x in zip(columns, rows[0]))
    return f"SELECT {names} FROM supplier, (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({', '.join(columns)})"


def _add_case(name: str, case: Case) -> None:
    _query(f"nodes_of_{name}", _case_sql(case, _NODE, case.nodes))(lambda spark, sf_dir: parsed_nodes(parse_files(_case_files(spark, sf_dir, case))).select(_NODE))
    if case.edges:

        def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
            parsed = _parsed(_case_files(spark, sf_dir, case))
            return parsed_edges(parsed, parsed.select("file_path")).select(_EDGE)

        _query(f"edges_of_{name}", _case_sql(case, _EDGE, case.edges))(edges)


for _name, _case in CASES.items():
    _add_case(_name, _case)


@_query("local_modules", "SELECT 'USES_MODULE' AS kind, '/c/' || s_suppkey || '/m.tf::m' || s_suppkey AS source_qualified, CASE WHEN s_suppkey % 2 = 0 THEN '/c/' || s_suppkey || '/near' || s_suppkey || '/main.tf' ELSE './near' || s_suppkey END AS target_qualified FROM supplier")
def _local_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge of a local module leads to its main file where that is among the files."""
    files = _case_files(spark, sf_dir, CASES["hcl"])
    key = F.regexp_extract("file_path", r"/(\d+)/", 1)
    near = files.filter(key.cast("long") % 2 == 0).select(F.concat(F.lit("/c/"), key, F.lit("/near"), key, F.lit("/main.tf")).alias("file_path"), F.encode(F.lit(""), "UTF-8").alias("content"))
    parsed = _parsed(files.unionByName(near))
    return parsed_edges(parsed, parsed.select("file_path")).filter("kind = 'USES_MODULE'").select("kind", "source_qualified", "target_qualified")


@_query("registered_parser", "SELECT 'Word' AS kind, 'w' || s_suppkey AS name FROM supplier")
def _registered_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser for an extension of one's own takes part in a build like the others."""

    def words(path: str, content: bytes) -> FileRows:
        rows = FileRows(path, "words")
        for w in content.decode().split():
            rows.node("Word", w, 1, 1)
        return rows

    before, spoken = dict(registry.PARSERS), dict(registry.LANGUAGES)
    try:
        registry.register_parser([".WORDS"], words, "words")
        assert registry.detect_language("a.words") == "words"
        made = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('/w/', s_suppkey, '.words') AS file_path", "CAST(concat('w', s_suppkey) AS BINARY) AS content")
        return parsed_nodes(parse_files(made)).select("kind", "name")
    finally:
        for held, old in ((registry.PARSERS, before), (registry.LANGUAGES, spoken)):
            held.clear()
            held.update(old)


@_query("registered_detector", "SELECT 'NEAR' AS kind, '/c/' || s_suppkey || '/m.tf' AS source_qualified, '/c/' || s_suppkey || '/m.tf::o' || s_suppkey AS target_qualified FROM supplier")
def _registered_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of one's own adds edges to those of the others."""

    def near(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return nodes.filter("kind = 'Output'").select(F.lit("NEAR").alias("kind"), F.col("file_path").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), "file_path", F.lit(0).alias("line"), F.lit("{}").alias("extra"), "ord")

    before = list(xref.DETECTORS)
    try:
        xref.register_detector(near)
        parsed = _parsed(_case_files(spark, sf_dir, CASES["hcl"]))
        found = xref.detect(parsed_nodes(parsed), parsed_edges(parsed, parsed.select("file_path")))
        assert found.columns == [f.split()[0] for f in EDGE_DDL.split(", ")]
        return found.filter("kind = 'NEAR'").select("kind", "source_qualified", "target_qualified")
    finally:
        xref.DETECTORS[:] = before


@_query("decoded_bytes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65533) || text ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def _decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that aren't UTF-8 come out as the replacement character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    lead = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return docs.select("doc_id", decoded(F.concat(lead, F.encode("text", "UTF-8"))).alias("text"))


@_query("resolved_symbols", "SELECT '/c/' || s_suppkey || '/p.py::' || c AS source_qualified, '/c/' || s_suppkey || '/p.py::' || t AS target_qualified FROM supplier, LATERAL (VALUES ('N' || s_suppkey || '.read', 'inner'), ('N' || s_suppkey || '.test_read', 'N' || s_suppkey || '.read')) v(c, t) UNION ALL SELECT '/c/' || s_suppkey || '/p.py', '/c/' || s_suppkey || '/p.py::main' || s_suppkey FROM supplier")
def _resolved_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in: calls whose text names a function of the same file lead to it."""
    parsed = _parsed(_case_files(spark, sf_dir, CASES["python"]))
    edges = xref.resolve_symbols(parsed_nodes(parsed), parsed_edges(parsed, parsed.select("file_path")))
    return edges.filter("kind = 'CALLS' AND target_qualified LIKE '/c/%'").select("source_qualified", "target_qualified").distinct()


@_query("linked_build", """SELECT 'READS_CONFIG' AS kind, '/l/' || s_suppkey || '.py::read' AS source_qualified, '/l/c' || s_suppkey || '.yaml' AS target_qualified FROM supplier
UNION ALL SELECT 'RENDERS', '/l/' || s_suppkey || '.py::show', '/l/t' || s_suppkey || '.j2' FROM supplier UNION ALL SELECT 'CALLS', '/l/' || s_suppkey || '.py::show', '/l/' || s_suppkey || '.py::read' FROM supplier""")
def _linked_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in of a build: calls of a file's own functions, and calls that name YAML and template files, lead there."""
    text = 'import yaml\n\ndef read():\n    return yaml.safe_load(open("conf/c{k}.yaml"))\n\ndef show(env):\n    return env.get_template("t{k}.j2").render(read())\n'
    files = None
    for name, content in (("{k}.py", text), ("c{k}.yaml", "a: 1\n"), ("t{k}.j2", "{{ a }}")):
        key = F.col("s_suppkey").cast("string")
        made = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("/l/"), F.replace(F.lit(name), F.lit("{k}"), key)).alias("file_path"), F.encode(F.replace(F.lit(content), F.lit("{k}"), key), "UTF-8").alias("content"))
        files = made if files is None else files.unionByName(made)
    store = GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ingest.build_files(store, files, ["/l"], link=True)
    return store.edges.filter("kind IN ('READS_CONFIG', 'RENDERS') OR kind = 'CALLS' AND target_qualified LIKE '/l/%'").select("kind", "source_qualified", "target_qualified")


@_query("tests_named", "SELECT 'test_' || s_suppkey AS name, 'named' AS how FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 'check_7', 'linked'")
def _tests_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that an edge leads to, and test functions named after a function."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("explode(array('s', 'test_', 'check_', 'plain_test_')) AS p", "s_suppkey AS k").filter("p <> 'plain_test_' OR k = 7")
    nodes = n.selectExpr("'Function' AS kind", "concat(p, k) AS name", "concat('/t.py::', p, k) AS qualified_name", "'/t.py' AS file_path", "p = 'test_' AS is_test", "k * 10 + length(p) AS ord").filter("name = 'test_7' OR name NOT LIKE 'test\\_7%'")
    edges = spark.createDataFrame([("TESTED_BY", "/t.py::check_7", "/t.py::s7", "/t.py", 1, 0), ("CALLS", "/t.py::check_8", "/t.py::s7", "/t.py", 1, 1)], "kind string, source_qualified string, target_qualified string, file_path string, line int, ord long")
    return patterns.tests_for(nodes, edges, "/t.py::s7", "7").select("name", F.when(F.col("name").startswith("check"), "linked").otherwise("named").alias("how"))


@_query("metadata_values", "SELECT 'last_build_type' AS key, 'full' AS value UNION ALL SELECT 'last_updated', 'a time' UNION ALL SELECT 'mine', 'second'")
def _metadata_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put last is what is got; a build leaves its kind and its time, in whole seconds."""
    store = GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ingest.build_files(store, _case_files(spark, sf_dir, CASES["helm_values"]), ["/c"])
    store.set_metadata(mine="first")
    store.set_metadata(mine="second")
    assert store.get_metadata("mine") == "second" and store.get_metadata("nothing") is None
    time = F.when(F.col("value").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), "a time").otherwise(F.col("value"))
    return store.metadata.select("key", F.when(F.col("key") == "last_updated", time).otherwise(F.col("value")).alias("value"))


@_query("rows_as_dictionaries", "SELECT '/c/' || s_suppkey || '/values.yaml' AS source, '/c/' || s_suppkey || '/values.yaml::' || x AS target, 'extra file_path kind line ord source target' AS keys FROM supplier, (VALUES ('replicas'), ('image')) v(x)")
def _rows_as_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(_case_files(spark, sf_dir, CASES["helm_values"]))
    rows = to_json_rows(parsed_edges(parsed, parsed.select("file_path")))
    return spark.createDataFrame([(r["source"], r["target"], " ".join(sorted(r))) for r in rows], "source string, target string, keys string")


# A repository under git for the nations and regions, and what is done with it.
class Laid(Path):
    """The root of a repository that is laid out on disk."""

    def put(self, name: str, text: str | bytes) -> None:
        at = self / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode() if isinstance(text, str) else text)

    def git(self, *args: str) -> None:
        subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=n@n", "-c", "commit.gpgsign=false", *args], cwd=self, check=True, capture_output=True, timeout=60)

    def config(self, groups: dict[str, Any] | None = None) -> Config:
        at = self.parent / "config.yaml"
        at.write_text(json.dumps({"graphs": groups or {}}))
        return Config(at)


def _lay_out(spark: SparkSession, sf_dir: str) -> tuple[Laid, list[tuple[int, int]]]:
    """(root, (nation, region) numbers): a Terraform file for each nation that reads its region's YAML file, and files that a build leaves out."""
    nations = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]
    root = Laid(f"{shared_dir(spark).removeprefix('file://')}/repo-{uuid.uuid4().hex}/made")
    for k, r in nations:
        root.put(f"tf/c{k}.tf", f'locals {{ a{k} = yamldecode(file("r{r}.yaml")) }}\n')
        root.put(f"skip/s{k}.tf", "locals { s = 1 }\n")
        root.put(f"node_modules/x{k}/x.yaml", "x: 1\n")
        root.put(f"docs/n{k}.md", "# text\n")
    for r in sorted({r for _, r in nations}):
        root.put(f"conf/r{r}.yaml", f"name: r{r}\n")
        root.put(f"conf/bin{r}.yaml", b"a: \0\n")
    root.put(sources.IGNORE_FILE, "# not these\n\nskip/**\n")
    root.git("init", "-q")
    root.git("add", "-A")
    root.git("commit", "-q", "-m", "all")
    return root, nations


def _rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


_FILES = "SELECT 'tf/c' || n_nationkey || '.tf' AS name FROM nation UNION ALL SELECT 'conf/r' || r_regionkey || '.yaml' FROM region"


@_query("discovered_files", _FILES)
def _discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked, not ignored, of a known kind and no binary: in that order."""
    root, _ = _lay_out(spark, sf_dir)
    root.put("tf/untracked.tf", "locals { u = 1 }\n")
    os.symlink(root / "tf/c0.tf", root / "tf/link.tf")
    root.git("add", "tf/link.tf")
    return sources.source_files(spark, str(root)).select(F.substring("file_path", len(str(root)) + 2, 1000).alias("name"))


@_query("walked_files", _FILES + " UNION ALL SELECT 'tf/more.tf'")
def _walked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without git, and through an address: every file under the root."""
    root, _ = _lay_out(spark, sf_dir)
    root.put("tf/more.tf", "locals { m = 1 }\n")
    (root / ".git").rename(root.parent / "gone")
    own = sources.source_files(spark, str(root)).select(F.substring("file_path", len(str(root)) + 2, 1000).alias("name"))
    url = sources.source_files(spark, f"file://{root}").select(F.substring("file_path", len(str(root)) + 9, 1000).alias("name"))
    return own.unionByName(url.filter("name NOT LIKE 'skip/%'")).distinct()  # an ignore file is read from plain roots alone


@_query("tracked_and_changed", "SELECT 'tracked' AS what, 'tf/c' || n_nationkey || '.tf' AS name FROM nation UNION ALL SELECT 'changed', 'tf/c' || n_nationkey || '.tf' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'changed', 'tf/new.tf' UNION ALL SELECT 'open', 'tf/c' || n_nationkey || '.tf' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'open', unnest(['tf/new.tf', 'tf/loose.tf', 'docs/moved.md']) UNION ALL SELECT 'staged', 'tf/new.tf' UNION ALL SELECT 'changed', 'docs/moved.md' UNION ALL SELECT 'staged', 'docs/moved.md'")
def _tracked_and_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What git tracks, what differs from a commit, what is staged where there is no such commit, and what isn't committed, a moved file under its new name."""
    root, nations = _lay_out(spark, sf_dir)
    for k, _ in nations:
        if k % 3 == 0:
            root.put(f"tf/c{k}.tf", f"locals {{ b{k} = 1 }}\n")
    root.put("tf/new.tf", "locals { n = 1 }\n")
    (root / "docs/n1.md").write_text("# a text of its own\n" * 9)
    root.git("add", "docs/n1.md")
    root.git("commit", "-q", "-m", "more", "docs/n1.md")
    root.git("mv", "docs/n1.md", "docs/moved.md")
    root.git("add", "tf/new.tf")
    root.put("tf/loose.tf", "locals { l = 1 }\n")
    at = str(root)
    found = [("tracked", n) for n in sources.tracked(at) if n.startswith("tf/c")] + [("changed", n) for n in sources.changed_since(at, "HEAD")]
    found += [("open", n) for n in sources.uncommitted(at)] + [("staged", n) for n in sources.changed_since(at, "no-such-commit")]
    return _rows(spark, found, "what string, name string")


@_query("roots_and_patterns", "SELECT unnest(['repository', 'fallback', 'own pattern', 'patterns']) AS what, unnest(['made', 'nowhere', 'skip/**', '24']) AS value")
def _roots_and_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root upwards of a folder, the folder itself where there is none, and the patterns of paths that are left out."""
    root, _ = _lay_out(spark, sf_dir)
    (root.parent / "nowhere").mkdir()
    own = sources.ignore_patterns(str(root))
    assert own[: len(sources.IGNORED)] == list(sources.IGNORED) and sources.repository_root(str(root.parent / "nowhere")) != str(root)
    rows = [("repository", os.path.basename(sources.project_root(str(root / "tf")))), ("fallback", os.path.basename(sources.project_root(str(root.parent / "nowhere")))), ("own pattern", own[-1]), ("patterns", str(len(own)))]
    return _rows(spark, rows, "what string, value string")


@_query("incremental_update_demo", """SELECT 'changed' AS what, 'conf/r' || r_regionkey || '.yaml' AS name FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'changed', 'tf/c' || n_nationkey || '.tf' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'dependent', 'tf/c' || n_nationkey || '.tf' FROM nation WHERE n_regionkey % 2 = 0
UNION ALL SELECT 'file', 'tf/c' || n_nationkey || '.tf' FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'file', 'conf/r' || r_regionkey || '.yaml' FROM region
UNION ALL SELECT 'section', 'name' FROM region UNION ALL SELECT 'section', 'more' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'reads', 'tf/c' || n_nationkey || '.tf::a' || n_nationkey FROM nation WHERE n_nationkey % 5 <> 0""")
def _incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files and those that read them; files that are gone leave, equal contents stay with their edges."""
    root, nations = _lay_out(spark, sf_dir)
    store = GraphStore(spark, f"file://{root.parent}/store")
    ingest.full_build(store, str(root))
    for k, r in nations:
        if r % 2 == 0:
            root.put(f"conf/r{r}.yaml", f"name: r{r}\nmore: 1\n")
        if k % 5 == 0:
            (root / f"tf/c{k}.tf").unlink()
    made = ingest.incremental_update(store, str(root), "HEAD")
    rows = [("changed", n) for n in made["changed_files"]] + [("dependent", n) for n in made["dependent_files"]]
    name = F.substring("qualified_name", len(str(root)) + 2, 1000)
    held = store.nodes.filter("kind = 'File'").select(F.lit("file").alias("what"), name.alias("name")).unionByName(store.nodes.filter("kind = 'Section'").select(F.lit("section"), last_segment(F.col("qualified_name"))).toDF("what", "name"))
    reads = store.edges.filter("kind = 'READS_CONFIG'").select(F.lit("reads").alias("what"), F.substring("source_qualified", len(str(root)) + 2, 1000).alias("name"))
    return _rows(spark, rows, "what string, name string").unionByName(held).unionByName(reads)


@_query("group_build", "SELECT 2::BIGINT AS repos, 2 * ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region)) AS files, 2 * 2 * ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region)) AS nodes, (SELECT count(*) FROM nation) * 4 + 2 * (SELECT count(*) FROM region) AS edges, 2 * (SELECT count(*) FROM nation) AS across, 'full_group' AS build")
def _group_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both repositories of a group in one job, and edges across files once."""
    one, two = _lay_out(spark, sf_dir)[0], _lay_out(spark, sf_dir)[0]
    config = one.config({"both": {"db": f"{one.parent}/both", "repos": [str(one), str(two)]}})
    made = api.build_or_update_graph(spark, group="both", config=config)
    return _rows(spark, [(made["repos_built"], made["files_parsed"], made["total_nodes"], made["total_edges"], made["cross_ref_edges"], made["build_type"])], "repos long, files long, nodes long, edges long, across long, build string")


def _built(spark: SparkSession, sf_dir: str) -> tuple[Laid, dict[str, Any]]:
    root, _ = _lay_out(spark, sf_dir)
    to = {"repo_root": str(root), "config": root.config()}
    api.build_or_update_graph(spark, full_rebuild=True, **to)
    return root, to


@_query("query_graph_outcomes", "SELECT unnest(['exact', 'relative', 'words', 'several', 'none', 'pattern', 'file', 'readers', 'across']) AS target, unnest(['ok', 'ok', 'ok', 'ambiguous', 'not_found', 'error', 'ok', 'ok', 'ok']) AS status, unnest([1, 1, 0, 5, 0, 0, 2, (SELECT count(*) FROM nation WHERE n_regionkey = 0), 1]) AS n")
def _query_graph_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target by its key, its key under the root, words that one node alone has or that several have, none, and an unknown query."""
    root, to = _built(spark, sf_dir)
    asked = {
        "exact": ("children_of", f"{root}/tf/c7.tf"), "relative": ("children_of", "tf/c7.tf"), "words": ("callees_of", "tf::A17"), "several": ("children_of", "tf/c"), "none": ("callers_of", "no such thing"),
        "pattern": ("nothing_of", "x"), "file": ("file_summary", "tf/c7.tf"), "readers": ("references_to", "conf/r0.yaml"), "across": ("cross_language", ""),
    }
    rows = []
    for name, (pattern, target) in asked.items():
        got = api.query_graph(spark, pattern, target, **to)
        rows.append((name, got["status"], len(got.get("results") or got.get("candidates") or [])))
    return _rows(spark, rows, "target string, status string, n long")


@_query("search_nodes_api", "SELECT 'c' || n_nationkey || '.tf' AS name, 'File' AS kind, 'hcl' AS language FROM nation WHERE 'tf/c' || n_nationkey || '.tf' LIKE '%tf/c1%'")
def _search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, to = _built(spark, sf_dir)
    got = api.search_nodes(spark, "TF/C1", kind="File", language="hcl", limit=20, **to)
    return _rows(spark, [(r["name"], r["kind"], r["language"]) for r in got["results"]], "name string, kind string, language string")


@_query("list_graph_stats_api", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS files, 2 * ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region)) AS nodes, 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS edges, 'hcl yaml' AS languages, (SELECT count(*) FROM nation) AS locals, true AS stamped")
def _list_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, to = _built(spark, sf_dir)
    got = api.list_graph_stats(spark, **to)
    return _rows(spark, [(got["files_count"], got["total_nodes"], got["total_edges"], " ".join(got["languages"]), got["nodes_by_kind"]["Local"], bool(got["last_updated"]))], "files long, nodes long, edges long, languages string, locals long, stamped boolean")


@_query("impact_radius_api", "SELECT 'file' AS what, 'tf/c' || n_nationkey || '.tf' AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'node', 'a' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'changed', unnest(['r1.yaml', 'name'])")
def _impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without files given, what isn't committed counts as changed: here one region's file, and its readers are reached."""
    root, to = _built(spark, sf_dir)
    root.put("conf/r1.yaml", "name: r1\nmore: 1\n")
    got = api.get_impact_radius(spark, base="HEAD", **to)
    rows = [("file", f.removeprefix(f"{root}/")) for f in got["impacted_files"]] + [("node", n["name"]) for n in got["impacted_nodes"]] + [("changed", n["name"]) for n in got["changed_nodes"]]
    return _rows(spark, rows, "what string, name string")


@_query("review_context_api", "SELECT 'conf/r1.yaml' AS file, '1: name: r1' || chr(10) || '2: more: 1' AS snippet, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS reached UNION ALL SELECT 'tf/c2.tf', '1: locals { z = 1 }' || chr(10) || '... (1 more lines)', (SELECT count(*) FROM nation WHERE n_nationkey <> 2 AND n_regionkey IN (1, (SELECT n_regionkey FROM nation WHERE n_nationkey = 2)))")
def _review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of the changed files, up to a limit, and how many files they reach."""
    root, to = _built(spark, sf_dir)
    root.put("conf/r1.yaml", "name: r1\nmore: 1\n")
    rows = []
    for name, most in (("conf/r1.yaml", 200), ("tf/c2.tf", 1)):
        if name.startswith("tf"):
            root.put(name, "locals { z = 1 }\n# more\n")
        got = api.get_review_context(spark, ["conf/r1.yaml", name], max_lines_per_file=most, **to)["context"]
        rows.append((name, got["source_snippets"][name], len([f for f in got["impacted_files"] if f.endswith(".tf")])))
    return _rows(spark, rows, "file string, snippet string, reached long")


@_query("build_api", "SELECT unnest(['full', 'incremental', 'incremental']) AS build, unnest([(SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 0, 1]) AS files, unnest(['ok', 'ok', 'ok']) AS status")
def _build_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full build, an update of nothing and an update of a new file; a folder that isn't a repository is refused."""
    root, _ = _lay_out(spark, sf_dir)
    to = {"repo_root": str(root), "config": root.config()}
    got = [api.build_or_update_graph(spark, full_rebuild=True, **to), api.build_or_update_graph(spark, base="HEAD", **to)]
    root.put("tf/new.tf", "locals { n = 1 }\n")
    root.git("add", "tf/new.tf")
    got.append(api.build_or_update_graph(spark, base="HEAD", **to))
    for refused in (str(root.parent), str(root / "no such folder")):
        with contextlib.suppress(ValueError):
            api.build_or_update_graph(spark, repo_root=refused, config=to["config"])
            raise AssertionError(f"{refused} was taken for a repository")
    return _rows(spark, [(m["build_type"], m.get("files_parsed", m.get("files_updated")), m["status"]) for m in got], "build string, files long, status string")


@contextlib.contextmanager
def _home(root: Laid) -> Iterator[None]:
    """The command line with its settings file beside a repository."""
    held = command.Config, command.write_default
    at = root.parent / "settings.yaml"
    command.Config, command.write_default = lambda: Config(at), lambda: write_default(at)
    try:
        yield
    finally:
        command.Config, command.write_default = held


@_query("command_line", """SELECT 'init' AS command, 'settings.yaml' AS said UNION ALL SELECT 'groups', 'example' UNION ALL SELECT 'groups', 'missing' UNION ALL SELECT 'groups', 'missing'
UNION ALL SELECT 'build', ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region))::VARCHAR UNION ALL SELECT 'update', '1' UNION ALL SELECT 'status', ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1)::VARCHAR
UNION ALL SELECT 'build-group', ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1)::VARCHAR""")
def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each command, and what it says: a file, groups with a mark at folders that are missing, numbers of files."""
    root, _ = _lay_out(spark, sf_dir)
    rows: list[tuple[str, str]] = []

    def run(*args: str) -> list[str]:
        with contextlib.redirect_stdout(io.StringIO()) as out, _home(root):
            assert command.main(list(args)) == 0
        return out.getvalue().splitlines()

    rows.append(("init", os.path.basename(run("init")[0])))
    for line in run("groups"):
        rows.append(("groups", "missing" if line.endswith("(missing)") else line.split(":")[0]))
    db = ["--repo", str(root), "--db", f"file://{root.parent}/db"]
    rows.append(("build", str(eval(run("build", *db)[0], {})["files_parsed"])))  # noqa: S307
    root.put("tf/new.tf", "locals { n = 1 }\n")
    root.git("add", "tf/new.tf")
    rows.append(("update", str(eval(run("update", "--base", "HEAD", *db)[0], {})["files_updated"])))  # noqa: S307
    rows.append(("status", str(eval(run("status", *db)[0], {})["files_count"])))  # noqa: S307
    (root.parent / "settings.yaml").write_text(json.dumps({"graphs": {"mine": {"db": f"{root.parent}/mine", "repos": [str(root)]}}}))
    rows.append(("build-group", run("build-group", "mine")[1].split(": ")[1].split(" files")[0]))
    return _rows(spark, rows, "command string, said string")


@_query("settings", """SELECT 'group' AS what, 'g' || r_regionkey AS name, '/made/g' || r_regionkey || ' ' || (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS value FROM region
UNION ALL SELECT 'store', 'n' || n_nationkey, '/made/g' || n_regionkey FROM nation UNION ALL SELECT 'store', 'own', '/other/.loomgraph/graph' UNION ALL SELECT 'store', 'default', '/made/all' UNION ALL SELECT 'broken', 'groups', '0'""")
def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with variables in their paths, the store of a repository by its group, its own or the default one, and a broken file as an empty one."""
    root, nations = _lay_out(spark, sf_dir)
    os.environ["LOOMGRAPH_MADE"] = "/made"
    groups: dict[str, Any] = {}
    for k, r in nations:
        groups.setdefault(f"g{r}", {"db": f"$LOOMGRAPH_MADE/g{r}", "repos": []})["repos"].append(f"$LOOMGRAPH_MADE/n{k}")
    config = root.config(groups)
    rows = [("group", g, f"{config.group_db(g)} {len(config.group_repos(g))}") for g in config.list_groups()]
    rows += [("store", f"n{k}", config.db_of(f"/made/n{k}")) for k, _ in nations] + [("store", "own", config.db_of("/other"))]
    (root.parent / "default.yaml").write_text("default_db: $LOOMGRAPH_MADE/all\n")
    rows.append(("store", "default", Config(root.parent / "default.yaml").db_of("/other")))
    (root.parent / "broken.yaml").write_text("graphs: [unclosed\n")
    broken = Config(root.parent / "broken.yaml")
    assert broken.exists and config.group_of("/made/n0") and config.group_of("/other") is None
    rows.append(("broken", "groups", str(len(broken.list_groups()))))
    return _rows(spark, rows, "what string, name string, value string")
