"""The store: buckets, numbers, writers that meet, and roots with an address."""

import pytest
from loomgraph.operators import ingest
from loomgraph.operators.store import ConcurrentUpdate, GraphStore


def files(spark, texts):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "file_path string, content binary")


def names(store):
    return sorted(r["name"] for r in store.nodes.collect())


def test_an_update_writes_the_buckets_of_its_files_alone(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s", buckets=8)
    ingest.build_files(store, files(spark, {f"/r/m{i}.py": f"def f{i}(): pass\n" for i in range(30)}), ["/r"])
    before = store._manifest()
    assert len(before["nodes"]) == 8 and before["next"] == 30 * 3, "two nodes and an edge a file, numbered without gaps"
    assert sorted(r["ord"] for r in store.nodes.select("ord").unionByName(store.edges.select("ord")).collect()) == list(range(90))
    changed = files(spark, {"/r/m3.py": "def g3(): pass\n"})
    first = store.begin()
    from loomgraph.sources.registry import parse_files

    ingest.replace_parsed(store, parse_files(changed), changed.limit(0), "stream", first)
    after = store._manifest()
    touched = {str(b) for b in store.touched(changed)}
    assert {b for b in before["nodes"] if before["nodes"][b] != after["nodes"][b]} == touched and len(touched) == 1
    assert {b for b in before["edges"] if before["edges"][b] != after["edges"][b]} <= touched
    assert "g3" in names(store) and "f3" not in names(store) and len(names(store)) == 60 and after["next"] == 93
    assert [r["name"] for r in store.nodes_of(changed).orderBy("ord").collect()] == ["m3.py", "g3"]
    store.vacuum()
    assert len(names(store)) == 60 and store.get_metadata("last_build_type") == "stream"


def test_a_writer_that_comes_between_is_noticed(spark, tmp_path):
    one, two = GraphStore(spark, f"file://{tmp_path}/s"), GraphStore(spark, f"file://{tmp_path}/s")
    one.begin()
    two.set_metadata(k="two")
    with pytest.raises(ConcurrentUpdate):
        one.set_metadata(k="one")
    assert one.get_metadata("k") == "two"
    one.begin()
    one.set_metadata(k="one")
    assert two.get_metadata("k") == "one"


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_of_equal_content_stay_whatever_the_root(spark, tmp_path, scheme):
    root = tmp_path / "r"
    root.mkdir()
    (root / "m.tf").write_text('locals { a = yamldecode(file("c.yaml")) }\n')
    (root / "c.yaml").write_text("a: 1\n")
    store = GraphStore(spark, f"file://{tmp_path}/s")
    ingest.full_build(store, f"{scheme}{root}")
    (root / "c.yaml").write_text("b: 1\n")
    made = ingest.incremental_update(store, f"{scheme}{root}", changed=["c.yaml", "gone.tf"])
    assert made["dependent_files"] == ["m.tf"] and names(store) == ["a", "b", "c.yaml", "m.tf"]
