"""Builds of small repositories, updates, the public interface, streams and the command line."""

import shutil

import pytest
from loomgraph import __main__ as cli
from loomgraph import api
from loomgraph.operators import ingest, xref
from loomgraph.operators.store import GraphStore
from loomgraph.sources import files as sources
from loomgraph.sources import registry
from loomgraph.sources.config import Config, write_default
from loomgraph.sources.rows import FileRows
from loomgraph.streaming.ingest import apply_batch, follow
from tests.test_parsers import DEPLOY, MAIN, PAGE, SVC


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    for path, content in {
        "a/main.tf": MAIN, "a/users/main.tf": b'variable "policies" {}\n', "b/out.tf": b'output "policy_arn" { value = "x" }\n', "a/app.yaml": b"name: demo\n", "k/deploy.yaml": DEPLOY, "t/page.j2": PAGE, "app/svc.py": SVC, "app/__init__.py": b"",
        "app/bin.py": b"x = '\x00'", "build/skip.py": b"", "gen/skip.py": b"", "README.txt": b"no", "vars.tfvars": b"count = 3\n", ".loomgraphignore": b"# mine\n\ngen/*\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / ".git").mkdir()
    (root / "app/link.py").symlink_to(root / "app/svc.py")
    return root


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def snapshot(store):
    drop = ("ord",)
    return rows(store.nodes.drop(*drop), *[c for c in store.nodes.columns if c not in drop]), rows(store.edges.drop(*drop), *[c for c in store.edges.columns if c not in drop])


def test_files(spark, repo):
    found = [p.removeprefix(f"{repo}/") for (p,) in rows(sources.source_files(spark, str(repo)), "file_path")]
    assert found == ["a/app.yaml", "a/main.tf", "a/users/main.tf", "app/__init__.py", "app/svc.py", "b/out.tf", "k/deploy.yaml", "t/page.j2", "vars.tfvars"]
    assert sources.repository_root(str(repo / "app")) == str(repo) and sources.project_root("/") == "/"


def test_full_build(spark, repo, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    made = ingest.full_build(store, str(repo))
    assert made["files_parsed"] == 9 and made["cross_ref_edges"] == 2 and [e["file"] for e in made["errors"]] == ["vars.tfvars"]
    across = rows(store.edges.filter("kind IN ('READS_CONFIG', 'REMOTE_STATE')"), "kind", "source_qualified", "target_qualified")
    assert across == [("READS_CONFIG", f"{repo}/a/main.tf::cfg", f"{repo}/a/app.yaml"), ("REMOTE_STATE", f"{repo}/a/main.tf::terraform_remote_state.legacy", f"{repo}/b/out.tf::policy_arn")]
    assert rows(store.edges.filter("kind = 'USES_MODULE'"), "target_qualified") == [(f"{repo}/a/users/main.tf",)]
    assert store.edges.filter("kind = 'CALLS' AND target_qualified = 'print'").count() == 1 and made["total_edges"] > store.edges.count(), "totals count rows as emitted"
    assert store.get_metadata("last_build_type") == "full"
    first = snapshot(store)
    ingest.full_build(store, str(repo))
    assert snapshot(store) == first, "a second build changes nothing"
    (repo / "b/out.tf").unlink()
    ingest.full_build(store, str(repo))
    assert store.nodes.filter("file_path LIKE '%out.tf'").isEmpty() and store.edges.filter("kind = 'REMOTE_STATE'").isEmpty()


def test_incremental_update(spark, repo, tmp_path):
    store, root = GraphStore(spark, f"file://{tmp_path}/store"), str(repo)
    ingest.full_build(store, root)
    assert ingest.incremental_update(store, root, changed=[])["files_updated"] == 0
    before = snapshot(store)
    made = ingest.incremental_update(store, root, changed=["app/svc.py", "a/app.yaml"])
    assert made["dependent_files"] == ["a/main.tf"] and made["files_updated"] == 3 and made["total_nodes"] == 0 and snapshot(store) == before
    (repo / "app/svc.py").write_bytes(b"def fresh(): pass\n")
    (repo / "t/page.j2").unlink()
    (repo / "gen/skip.py").unlink()
    made = ingest.incremental_update(store, root, changed=["app/svc.py", "t/page.j2", "gen/skip.py", "README.txt"])
    assert made["total_nodes"] == 2 and rows(store.nodes.filter("file_path LIKE '%svc.py'"), "name") == [("fresh",), ("svc.py",)]
    assert store.nodes.filter("language = 'jinja2'").isEmpty() and store.get_metadata("last_build_type") == "incremental"
    everything = [p for p in sources.list_paths(root) if p != "app/bin.py"]  # an update parses what it is told to, binary or not
    other = GraphStore(spark, f"file://{tmp_path}/other")
    ingest.incremental_update(other, root, changed=everything)
    ingest.full_build(store, root)
    assert rows(other.nodes, "qualified_name", "file_hash") == rows(store.nodes, "qualified_name", "file_hash"), "an update of all files is a build without edges across files"
    assert rows(other.edges, "kind", "source_qualified", "target_qualified") == rows(store.edges.filter("kind NOT IN ('READS_CONFIG', 'REMOTE_STATE')"), "kind", "source_qualified", "target_qualified")


def test_group_and_interface(spark, repo, tmp_path):
    two = tmp_path / "two"
    shutil.copytree(repo / "b", two / "b")
    settings = tmp_path / "config.yaml"
    settings.write_text(f"default_db: {tmp_path}/default\ngraphs:\n  g:\n    db: {tmp_path}/g\n    repos: [{repo}, {two}, {tmp_path}/missing]\n")
    config = Config(settings)
    made = api.build_or_update_graph(spark, group="g", config=config)
    assert made["repos_built"] == 2 and made["files_parsed"] == 10 and made["cross_ref_edges"] == 3
    assert config.group_of(str(two)) == "g" and config.db_of("/elsewhere") == f"{tmp_path}/default" and config.list_groups() == ["g"]
    ask = lambda pattern, target="": api.query_graph(spark, pattern, target, group="g", config=config)
    assert ask("nonsense")["status"] == "error" and ask("callers_of", "zzz")["status"] == "not_found" and ask("children_of", "policy_arn")["status"] == "ambiguous"
    assert {r["name"] for r in ask("children_of", "app/svc.py")["results"]} == {"Base", "Svc", "run"}
    assert ask("imports_of", "app/svc.py")["results"] == [{"import_target": "os"}, {"import_target": "yaml.safe_load"}]
    assert ask("cross_language")["results"] == [{"total_cross_language_edges": 1}] and len(ask("cross_language")["edges"]) == 1
    assert len(ask("file_summary", "app/svc.py")["results"]) == 5
    assert ask("references_to", f"{repo}/a/main.tf::region")["results"][0]["name"] == "aws_vpc.main"
    found = api.search_nodes(spark, "run", kind="Function", group="g", config=config)
    assert [r["name"] for r in found["results"]] == ["run"] and set(found["results"][0]) == set(api.NODE_FIELDS)
    told = api.list_graph_stats(spark, group="g", config=config)
    assert told["files_count"] == 9 and told["languages"] == ["hcl", "jinja2", "python", "yaml"] and told["last_updated"]
    reach = api.get_impact_radius(spark, ["a/app.yaml"], group="g", config=config)
    assert f"{repo}/a/main.tf" in reach["impacted_files"] and {e["kind"] for e in reach["edges"]} >= {"READS_CONFIG"} and "source" in reach["edges"][0]
    context = api.get_review_context(spark, ["app/svc.py", "gone.py"], group="g", config=config, max_lines_per_file=2)["context"]
    assert context["source_snippets"] == {"app/svc.py": "1: import os\n2: from yaml import safe_load\n... (11 more lines)"}
    assert api.get_impact_radius(spark, [], group="g", config=config)["impacted_files"] == []
    own = api.build_or_update_graph(spark, True, str(repo), config=Config(tmp_path / "none.yaml"))
    assert own["build_type"] == "full" and (repo / ".loomgraph/.gitignore").read_text() == "*\n" and own["files_parsed"] == 9
    for bad in ({"group": "none"}, {"repo_root": f"{tmp_path}/missing"}, {"repo_root": str(two)}):
        with pytest.raises(ValueError):
            api.open_store(spark, config=config, **bad)


def test_plug_ins(spark, tmp_path):
    def parse_ini(path, content):
        out = FileRows(path, "ini")
        out.node("File", out.base, 1, 1)
        return out

    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.ini").write_bytes(b"[a]")
    registry.register_parser([".INI"], parse_ini, "ini")
    xref.register_detector(lambda nodes, edges: edges.limit(0))
    try:
        store = GraphStore(spark, f"file://{tmp_path}/s")
        assert ingest.full_build(store, f"{tmp_path}/x")["files_parsed"] == 1 and rows(store.nodes, "language") == [("ini",)]
    finally:
        del registry.PARSERS[".ini"], registry.LANGUAGES["ini"], xref.DETECTORS[-1]


def test_stream(spark, repo, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    spark.createDataFrame([("/s/a.py", bytearray(SVC), 1), ("/s/a.py", bytearray(b"def late(): pass"), 2), ("/s/b.txt", bytearray(b"x"), 1), (None, bytearray(b"x"), 1)], "file_path string, content binary, arrived int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file_path string, content binary, arrived int").parquet(f"{tmp_path}/in")
    follow(store, stream, f"{tmp_path}/check", once=True).awaitTermination(120)
    assert rows(store.nodes, "name") == [("a.py",), ("late",)]
    held = store._text("CURRENT")
    apply_batch(store, spark.createDataFrame([("/s/a.py", bytearray(b"def late(): pass"))], "file_path string, content binary"))
    assert store._text("CURRENT") == held, "a batch that comes again changes nothing"
    apply_batch(store, spark.createDataFrame([("/s/a.py", None)], "file_path string, content binary"))
    assert store.nodes.isEmpty()


def test_command_line(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "Config", lambda: Config(tmp_path / "none.yaml"))
    assert cli.main(["build", "--repo", str(repo), "--db", f"{tmp_path}/db"]) == 0
    assert "'files_parsed': 9" in capsys.readouterr().out
    cli.main(["status", "--repo", str(repo), "--db", f"{tmp_path}/db"])
    assert "total_nodes" in capsys.readouterr().out
    at = write_default(tmp_path / "new/config.yaml")
    assert Config(at).list_groups() == ["example"] and write_default(at, {"other": {}}) == at and Config(at).list_groups() == ["example"]
