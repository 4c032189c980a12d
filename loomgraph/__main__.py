"""Command line: ``python -m loomgraph build|build-group|update|status|groups|init``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from loomgraph import api
from loomgraph.operators.ingest import full_build, incremental_update
from loomgraph.operators.store import GraphStore
from loomgraph.sources.config import Config, write_default


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description="A property graph of source code.")
    parser.add_argument("--version", action="version", version="loomgraph 1")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="write a settings file, unless there is one")
    sub.add_parser("groups", help="list the groups of repositories")
    sub.add_parser("build-group", help="build all repositories of a group").add_argument("name")
    for name, text in (("build", "build a repository"), ("update", "bring a repository up to date"), ("status", "show totals")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--repo", default=None)
        p.add_argument("--db", default=None)
        if name == "build":
            p.add_argument("--link", action="store_true", help="resolve names of Python files, and links to YAML and template files")
        if name == "update":
            p.add_argument("--base", default="HEAD~1")
    got, config = parser.parse_args(args), Config()
    if got.command == "init":
        print(write_default())
        return 0
    if got.command == "groups":
        for name in config.list_groups():
            print(f"{name}: {config.group_db(name)}")
            for r in config.group_repos(name):
                print(f"  {r}" + ("" if os.path.isdir(r) else " (missing)"))
        return 0
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if got.command == "build-group":
        print(api.build_or_update_graph(spark, group=got.name, config=config)["summary"])
        print(api.list_graph_stats(spark, group=got.name, config=config)["summary"])
        return 0
    if got.command == "status" and not got.db:
        print(api.list_graph_stats(spark, got.repo, config=config)["summary"])
        return 0
    store, root, _ = api.open_store(spark, got.repo, config=config)
    store = GraphStore(spark, got.db) if got.db else store
    if got.command == "status":
        print(api.stats.graph_stats(store.nodes, store.edges).first().asDict())
        return 0
    made = full_build(store, root, got.link) if got.command == "build" else incremental_update(store, root, got.base)
    print({k: v for k, v in made.items() if k != "errors"})
    for e in made["errors"][:5]:
        print(f"  {e['file']}: {e['error']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
