"""How work is laid out, so that a task's share doesn't grow with the input, and results stay the same."""

import pytest
from loomgraph.operators import joins, store, tables, traverse
from loomgraph.operators.schema import EDGE_DDL
from loomgraph.plans import catalog
from loomgraph.plans.projection import TABLES
from loomgraph.sources import registry
from loomgraph.sources.registry import parse_files
from loomgraph.sources.yaml_code import parse_yaml
from pyspark.sql import functions as F

from tests.test_graph import make_edges, make_nodes
from tests.test_queries import duck, same  # noqa: F401

SF = "/root/testdata/sf0.001"
SHUFFLE = "spark.sql.shuffle.partitions"
THRESHOLD = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def ran(rows):
    """The plan that ran, and the rows."""
    run = rows._jdf.queryExecution()
    got = sorted(map(str, rows.collect()))
    return run.executedPlan().toString(), got


#: Findings whose figure was a task's share of shuffles with a fixed number of partitions.
BY_SIZE = [
    "cross_language_edges",  # F1
    "cross_language_count",  # F2
    "impact_files",  # F7
    "impact_nodes",  # F8
    "impact_truncated",  # F9
    "edges_by_kind",  # F14
    "graph_stats",  # F15
    "count_edges",  # F16
    "build_totals",  # F17
]


@pytest.mark.parametrize("name", BY_SIZE)
def test_partitions_follow_the_size_of_the_tables(spark, duck, monkeypatch, name):
    """With a fixed number each task's share, and what it sorts and spills, grew with the input."""
    before = spark.conf.get(SHUFFLE)
    size = tables.bytes_of(spark, [f"{SF}/{t}.parquet" for t in TABLES])
    assert catalog.graph(spark, SF)[1].sparkSession.conf.get(SHUFFLE) == before, "a small input leaves what is set"
    monkeypatch.setattr(tables, "PARTITION_BYTES", size // 12)
    rows = catalog.QUERIES[name](spark, SF)
    assert int(rows.sparkSession.conf.get(SHUFFLE)) >= 12 and spark.conf.get(SHUFFLE) == before
    same(rows, duck, catalog.ORACLE_SQL[name])


def test_joins_hold_small_sides_by_hash(spark, monkeypatch):
    """both sides of each join were sorted."""
    monkeypatch.setattr(tables, "PARTITION_BYTES", 1 << 14)
    nodes, edges = catalog.graph(spark, SF)
    edges.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan, _ = ran(joins.cross_language(edges, nodes).groupBy("kind").count())
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan.split("== Initial Plan ==")[0]


def below_shuffle(plan):
    """The lines of the plan that run before its last shuffle."""
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    return lines[next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x) + 1 :]


def test_upserts_sort_after_the_shuffle_alone(spark):
    """aggregates of texts sorted all rows in the tasks that read them, and again behind the shuffle."""
    edges = make_edges(spark, [("CALLS", "/a::x", "/a::y"), ("READS", "/a::x", "/a::y"), ("CALLS", "/a::x", "/a::y", "/a", '{"n": 1}')]).repartition(3)
    for rows in (store.upsert_edges(edges), store.upsert_nodes(make_nodes(spark, [("Function", "x", "/a", "p"), ("Function", "x", "/a", "q")]).repartition(3))):
        plan, _ = ran(rows)
        assert not [x for x in below_shuffle(plan) if "Sort" in x]
    assert sorted((r.kind, r.extra, r.ord) for r in store.upsert_edges(edges).collect()) == [("CALLS", '{"n": 1}', 0), ("READS", "{}", 1)]


def test_adjacency_sorts_after_the_shuffle_alone(spark):
    """as F4."""
    edges = make_edges(spark, [("CALLS", "/a::x", "/a::y"), ("READS", "/a::x", "/a::y"), ("CALLS", "/a::x", "/a::y")]).repartition(3)
    plan, got = ran(traverse.adjacency(edges).select("source_qualified", "target_qualified", "kind"))
    assert not [x for x in below_shuffle(plan) if "Sort" in x]
    assert len(got) == 1 and "kind='CALLS'" in got[0]


def counted(spark, rows, ddl):
    """Rows that count how often each is made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, ddl), made


@pytest.fixture(scope="module")
def walked(spark):
    nodes = make_nodes(spark, [("File", "a", "/a", "p"), ("Function", "x", "/a", "p"), ("Function", "y", "/b", "p"), ("Function", "z", "/c", "p"), ("Function", "w", "/d", "p")])
    edges = make_edges(spark, [("CALLS", "/a::x", "/b::y"), ("CALLS", "/c::z", "/b::y"), ("CALLS", "/d::w", "/a::x"), ("CONTAINS", "/d::w", "/a::x"), ("CONTAINS", "/b::y", "/d::w"), ("CALLS", "/b::y", "/d::w")])
    return nodes, edges, spark.createDataFrame([("/a",)], "file_path string")


def test_impact_makes_the_edges_once(spark, walked):
    """F3, F7 to F9: the walk and the edges among what it reached each made all edges anew."""
    nodes, edges, changed = walked
    edges, made = counted(spark, edges, EDGE_DDL)
    found = traverse.impact(nodes, edges, changed, 2)
    assert sorted((r.qualified_name, r.depth) for r in found.nodes.collect()) == [("/b::y", 1), ("/c::z", 2), ("/d::w", 2)], "/d::w contains /a::x last, but /b::y calls it last"
    assert found.edges.count() == 6 and found.files.count() == 3 and found.total == 3 and not found.truncated
    assert made.value == 6


def test_changed_nodes_need_no_walk(spark, walked):
    """the whole walk ran for the nodes that it began at."""
    nodes, edges, changed = walked
    edges, made = counted(spark, edges, EDGE_DDL)
    assert sorted((r.qualified_name, r.depth) for r in traverse.impact(nodes, edges, changed, 2).changed.collect()) == [("/a", 0), ("/a::x", 0)]
    assert made.value == 0


def test_levels_merge_no_links_beforehand(spark, walked):
    """all links were grouped and written in both directions before the first step."""
    nodes, edges, changed = walked
    assert sorted((r.qualified_name, r.depth) for r in traverse.levels(nodes, edges, changed, 1).collect()) == [("/a", 0), ("/a::x", 0), ("/b::y", 1)]
    plan, _ = ran(traverse.marked_links(edges))
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_links_are_sifted_before_the_shuffle(spark, walked):
    """all links were shuffled for each level, though a level touches few."""
    nodes, edges, _ = walked
    links = tables.staged(traverse.marked_links(edges), "links")
    names = tables.staged(nodes.filter("file_path = '/a'").selectExpr("qualified_name", "0 AS depth"), "names")
    before = spark.conf.get(THRESHOLD)
    with tables.settings(spark, autoBroadcastJoinThreshold="-1"), traverse._sifted(spark, 2):
        found = traverse.neighbours(links, names.filter("depth = 0"))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("might_contain") == 2
        assert sorted(r[0] for r in found.collect()) == ["/b::y"]
    assert spark.conf.get(THRESHOLD) == before


@pytest.mark.parametrize("name", ["edges_of_helm_values", "edges_of_yaml"])
def test_edges_of_a_parser_parse_once(spark, name, tmp_path, monkeypatch):
    """each file was parsed for edges with and without a probe."""
    at = str(tmp_path / "parsed")

    def counting(path, content):
        with open(at, "a") as f:
            f.write(".")
        return parse_yaml(path, content)

    monkeypatch.setitem(registry.PARSERS, ".yaml", counting)
    assert catalog.QUERIES[name](spark, SF).count() > 0
    assert len(open(at).read()) == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_small_files_are_parsed_by_all_tasks(spark):
    """adaptive execution joined them to one task, however many."""
    files = spark.range(400).selectExpr("concat('/c/', id, '.yaml') AS file_path", "CAST('a: 1' AS BINARY) AS content")
    parsed = parse_files(files).withColumn("_task", F.spark_partition_id())
    assert parsed.select("_task").distinct().count() > 1 and parsed.count() == 400
