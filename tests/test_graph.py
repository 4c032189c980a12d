"""Queries, joins, statistics and traversal on a small hand-built graph."""

import random

import pytest
from loomgraph.operators import joins, lookup, patterns, stats, store, traverse, xref
from loomgraph.operators.schema import DEPENDENCY_KINDS, EDGE_DDL, METADATA_DDL, NODE_DDL


def make_nodes(spark, rows):
    """Rows of (kind, name, file, language[, is_test[, extra]])."""
    out = []
    for i, (kind, name, path, language, *more) in enumerate(rows):
        key = path if kind == "File" else f"{path}::{name}"
        out.append((kind, name, key, path, 1, 2, language, "", "", "", "", bool(more and more[0]), "h", more[1] if len(more) > 1 else "{}", i))
    return spark.createDataFrame(out, NODE_DDL)


def make_edges(spark, rows):
    """Rows of (kind, source, target[, file[, extra[, line]]])."""
    out = [(k, a, b, m[0] if m else a.split("::")[0], m[2] if len(m) > 2 else 0, m[1] if len(m) > 1 else "{}", i) for i, (k, a, b, *m) in enumerate(rows)]
    return spark.createDataFrame(out, EDGE_DDL)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = make_nodes(
        spark,
        [
            ("File", "a.py", "/a.py", "python"), ("Function", "one", "/a.py", "python"), ("Function", "two", "/a.py", "python"), ("File", "b.py", "/b.py", "python"), ("Function", "three", "/b.py", "python"),
            ("Function", "test_one", "/b.py", "python", True), ("File", "m.tf", "/m.tf", "hcl"), ("Resource", "aws.vpc", "/m.tf", "hcl"), ("File", "c.yaml", "/c.yaml", "yaml"), ("Section", "one_key", "/c.yaml", "yaml"),
            ("File", "n", "/n", ""), ("Class", "Kid", "/b.py", "python"),
        ],
    )
    edges = make_edges(
        spark,
        [
            ("CONTAINS", "/a.py", "/a.py::one"), ("CONTAINS", "/a.py", "/a.py::two"), ("CALLS", "/a.py::one", "/a.py::two"), ("CALLS", "/a.py::two", "/b.py::three"), ("CALLS", "/b.py::three", "/a.py::one"), ("CALLS", "/a.py::one", "/a.py::one"),
            ("CALLS", "/a.py::one", "print"), ("CALLS", "/b.py::test_one", "print"), ("IMPORTS", "/b.py", "/a.py"), ("READS_CONFIG", "/m.tf::aws.vpc", "/c.yaml"), ("TESTED_BY", "/b.py::test_one", "/a.py::one"),
            ("INHERITS", "/b.py::Kid", "/a.py::one"), ("CONTAINS", "/m.tf", "/m.tf::aws.vpc"), ("REFERENCES", "/m.tf", "/m.tf::aws.vpc"), ("IMPLEMENTS", "/n", "/a.py::two"),
        ],
    )
    return nodes, edges


def keys(rows, column="qualified_name"):
    return sorted(r[column] for r in rows.collect())


def test_lookups(graph):
    nodes, edges = graph
    assert keys(lookup.node(nodes, "/a.py::one")) == ["/a.py::one"]
    assert keys(lookup.nodes_of_file(nodes, "/m.tf")) == ["/m.tf", "/m.tf::aws.vpc"]
    assert lookup.with_language(nodes).count() == 11
    assert keys(lookup.search(nodes, "ONE a.py")) == ["/a.py::one"]
    assert keys(lookup.search(nodes, "t_o")) == ["/a.py::two", "/b.py::test_one"] and lookup.search(nodes, "a\\b").isEmpty() and lookup.search(nodes, " ").isEmpty()
    assert lookup.search(nodes, "%", 3).count() == 3
    assert keys(lookup.search_filtered(nodes, "one", kind="Section", limit=1)) == [], "the kind is looked at after the first two finds"
    assert keys(lookup.search_filtered(nodes, "one", kind="Section", limit=20)) == ["/c.yaml::one_key"]


def test_patterns(graph):
    nodes, edges = graph
    run = lambda name, key: patterns.PATTERNS[name](nodes, edges, key)
    assert keys(run("callers_of", "/a.py::one")) == ["/a.py::one", "/b.py::three"]
    assert keys(run("callees_of", "/a.py::one")) == ["/a.py::one", "/a.py::two"], "print is no node"
    assert patterns.pattern_edges(edges, nodes, "callees_of", "/a.py::one").count() == 3, "but its edge is there"
    assert keys(run("imports_of", "/b.py"), "import_target") == ["/a.py"]
    assert keys(run("importers_of", "/a.py"), "importer") == ["/b.py"]
    assert keys(run("children_of", "/a.py")) == ["/a.py::one", "/a.py::two"]
    assert keys(run("tests_for", "/a.py::one")) == ["/b.py::test_one"], "linked and named: once"
    assert keys(run("inheritors_of", "/a.py::one")) == ["/b.py::Kid"] and keys(run("inheritors_of", "/a.py::two")) == ["/n"]
    assert keys(run("references_to", "/c.yaml")) == ["/m.tf::aws.vpc"]
    assert keys(run("file_summary", "/c.yaml")) == ["/c.yaml", "/c.yaml::one_key"]
    assert run("cross_language", "").first()[0] == 1
    assert patterns.resolve_target(nodes, "aws.vpc")[0] == "ok" and patterns.resolve_target(nodes, "one")[0] == "ambiguous" and patterns.resolve_target(nodes, "zz")[0] == "not_found"
    assert patterns.resolve_target(nodes, "a.py", "")[0] == "ambiguous" and patterns.resolve_target(nodes, "b.py::three", "/x")[0] == "ok"


def test_joins(graph, spark):
    nodes, edges = graph
    some = nodes.filter("file_path = '/a.py'")
    assert joins.edges_among(edges, some).count() == 4
    assert joins.subgraph_edges(edges, some.unionByName(some)).count() == 8
    assert keys(joins.file_dependents(edges, nodes, "/a.py"), "file_path") == ["/b.py"]
    changed = spark.createDataFrame([("/a.py",), ("/b.py",), ("/c.yaml",)], "file_path string")
    assert keys(joins.dependents(edges, nodes, changed), "file_path") == ["/a.py", "/b.py", "/m.tf"]


def test_stats(graph, spark):
    row = stats.graph_stats(*graph).first()
    assert (row.total_nodes, row.total_edges, row.files_count, row.languages) == (12, 15, 5, ["hcl", "python", "yaml"])
    assert row.nodes_by_kind["File"] == 5 and row.edges_by_kind["CALLS"] == 6
    empty = stats.graph_stats(spark.createDataFrame([], NODE_DDL), spark.createDataFrame([], EDGE_DDL)).first()
    assert (empty.total_nodes, empty.total_edges, empty.files_count, empty.languages, empty.nodes_by_kind) == (0, 0, 0, [], {})


def brute_levels(nodes, edges, files, depth, most):
    """The walk in plain Python."""
    last = {}
    for e in sorted(edges, key=lambda e: e["ord"]):
        last[e["source_qualified"], e["target_qualified"]] = e["kind"]
    near = {}
    for (a, b), kind in last.items():
        if kind in DEPENDENCY_KINDS and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {n["qualified_name"]: 0 for n in nodes if n["file_path"] in files}
    step = set(found)
    for d in range(1, depth + 1):
        step = {y for x in step for y in near.get(x, ())} - set(found)
        found |= dict.fromkeys(step, d)
        if not step or len(found) > most:
            break
    return found


def test_impact(graph, spark):
    nodes, edges = graph
    found = traverse.impact(nodes, edges, spark.createDataFrame([("/m.tf",)], "file_path string"), 2)
    assert keys(found.changed) == ["/m.tf", "/m.tf::aws.vpc"] and keys(found.nodes) == ["/c.yaml"] and keys(found.files, "file_path") == ["/c.yaml"]
    assert found.edges.count() == 3 and not found.truncated and found.total == 1
    found = traverse.impact(nodes, edges, spark.createDataFrame([("/a.py",)], "file_path string"), 3, 2)
    assert found.truncated and found.nodes.count() == 2 and keys(found.nodes) == ["/b.py", "/b.py::Kid"]
    none = traverse.impact(nodes, edges, spark.createDataFrame([("/zz",)], "file_path string"))
    assert none.nodes.isEmpty() and none.changed.isEmpty() and none.total == 0


@pytest.mark.parametrize("seed", range(3))
def test_walk_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [(f"f{i % 9}", f"n{i}") for i in range(60)]
    nodes = make_nodes(spark, [("Function", n, f, "python") for f, n in names])
    ends = [f"{f}::{n}" for f, n in names] + ["print", "os"]
    edges = make_edges(spark, [(rng.choice(["CALLS", "CONTAINS", "IMPORTS", "RENDERS"]), rng.choice(ends), rng.choice(ends)) for _ in range(90)])
    for depth, most in ((1, 500), (3, 500), (4, 12)):
        got = traverse.levels(nodes, edges, spark.createDataFrame([("f1",), ("f2",), ("f1",)], "file_path string"), depth, most)
        assert {r.qualified_name: r.depth for r in got.collect()} == brute_levels([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()], {"f1", "f2"}, depth, most)


def test_mutations(graph, spark):
    nodes, edges = graph
    twice = nodes.unionByName(nodes.filter("name = 'one'").withColumn("kind", nodes.kind.substr(1, 3)).withColumn("ord", nodes.ord + 100))
    merged = store.upsert_nodes(twice).filter("qualified_name = '/a.py::one'").collect()
    assert [(r.kind, r.ord) for r in merged] == [("Fun", 1)], "the last row's values at the first row's place"
    double = edges.unionByName(edges.filter("ord = 2").selectExpr("kind", "source_qualified", "target_qualified", "file_path", "line", "'{\"x\": 1}' AS extra", "ord + 100 AS ord"))
    row = store.upsert_edges(double).filter("ord = 2").collect()
    assert store.upsert_edges(double).count() == 15 and row[0].extra == '{"x": 1}'
    gone = store.remove_files(edges, spark.createDataFrame([("/a.py",)], "file_path string"))
    assert gone.filter("target_qualified = '/a.py'").count() == 1, "edges of other files stay"
    current = spark.createDataFrame([("/x/app/k.py",)], "file_path string")
    stored = make_nodes(spark, [("File", "k", "/x/app/k.py", ""), ("File", "o", "/x/app/o.py", ""), ("File", "t", "/x/app-two/t.py", "")])
    assert keys(store.stale_files(stored, current, "/x/app"), "file_path") == ["/x/app/o.py"], "a folder beside it stays"


def test_store_snapshots(graph, spark, tmp_path):
    nodes, edges = graph
    held = store.GraphStore(spark, f"file://{tmp_path}/s")
    assert held.nodes.isEmpty() and held.get_metadata("k") is None
    held.commit(nodes, edges, {"k": "v"})
    before = held.nodes
    held.replace(spark.createDataFrame([("/a.py",)], "file_path string"), nodes.filter("name = 'one'"), edges.limit(0), {"j": "w"})
    assert keys(lookup.nodes_of_file(held.nodes, "/a.py")) == ["/a.py::one"] and before.count() == 12, "readers of the old snapshot aren't disturbed"
    assert (held.get_metadata("k"), held.get_metadata("j")) == ("v", "w") and sorted(held.metadata.columns) == sorted(METADATA_DDL.replace(" string", "").split(", "))
    held.vacuum()
    assert held.edges.count() == edges.filter("file_path <> '/a.py'").count()
    assert store.to_json_rows(held.edges.filter("kind = 'IMPLEMENTS'").select("kind", "source_qualified")) == [{"kind": "IMPLEMENTS", "source": "/n"}]


def test_detectors(spark):
    nodes = make_nodes(
        spark,
        [
            ("File", "s.py", "/r/s.py", "python"), ("Function", "f", "/r/s.py", "python"), ("File", "app.yaml", "/old/app.yaml", "yaml"), ("File", "app.yaml", "/r/app.yaml", "yaml"), ("File", "p.j2", "/r/p.j2", "jinja2"),
            ("Local", "cfg", "/r/a/m.tf", "hcl", False, '{"value": "${yamldecode(file(\\"app.yaml\\"))} ${templatefile(\\"x/p.j2\\", {})}"}'), ("DataSource", "terraform_remote_state.net", "/r/a/m.tf", "hcl"),
            ("Output", "vpc", "/r/a/m.tf", "hcl", False, '{"value": "${data.terraform_remote_state.net.outputs.vpc}"}'), ("Output", "vpc", "/r/b/o.tf", "hcl"), ("Output", "other", "/r/b/o.tf", "hcl"),
        ],
    )
    edges = make_edges(
        spark,
        [
            ("CALLS", "/r/s.py::f", "yaml::safe_load", "/r/s.py", "{}", 7), ("CALLS", "/r/s.py::f", "open", "/r/s.py", '{"raw_target": "conf/app.yaml"}'), ("CALLS", "/r/s.py::f", "safe_load", "/r/s.py", "{}", 9),
            ("CALLS", "/r/s.py::f", "env::get_template", "/r/s.py", '{"raw_target": "p.j2"}', 3), ("CALLS", "/r/s.py::f", "render_template", "/r/s.py", '{"raw_target": "none.j2"}'),
        ],
    )
    got = sorted((r.kind, r.source_qualified, r.target_qualified, r.line) for r in xref.detect(nodes, edges).collect())
    assert got == [
        ("READS_CONFIG", "/r/a/m.tf::cfg", "/r/app.yaml", 0), ("READS_CONFIG", "/r/s.py::f", "/r/app.yaml", 7), ("REMOTE_STATE", "/r/a/m.tf::terraform_remote_state.net", "/r/b/o.tf::vpc", 0),
        ("RENDERS", "/r/a/m.tf::cfg", "/r/p.j2", 0), ("RENDERS", "/r/s.py::f", "/r/p.j2", 3),
    ]


def test_resolved_symbols(spark):
    nodes = make_nodes(spark, [("Function", "f", "/a.py", "python"), ("Method", "m", "/a.py", "python"), ("K8sResource", "ConfigMap/c", "/c.yaml", "yaml")])
    edges = make_edges(spark, [("CALLS", "/a.py::x", "f", "/a.py"), ("CALLS", "/a.py::x", "self.m", "/a.py"), ("CALLS", "/b.py::x", "f", "/b.py"), ("REFERENCES", "/d.yaml::d", "k8s::ConfigMap/c", "/d.yaml")])
    assert [r.target_qualified for r in xref.resolve_symbols(nodes, edges).orderBy("ord").collect()] == ["/a.py::f", "/a.py::m", "f", "/c.yaml::ConfigMap/c"]
