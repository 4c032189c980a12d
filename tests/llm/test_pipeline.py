"""The corpus pipeline, stage by stage, on made documents and on the small tables."""

import random

import corpus_pipeline
import numpy as np
from loomgraph.llm import packing, quality, simhash
from loomgraph.llm._tokens import encoder
from tests.llm.data import EDGES, prose
from tests.llm.test_quality import made
from tests.llm.test_repeats import brute, line_runs
from tests.llm.test_search import edited


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    bench = [(i, prose(rng, 40)) for i in range(8)]
    clean = [(i, prose(rng, rng.randint(60, 200)).replace(". ", ".\n")) for i in range(60)]
    rows = [(i, t, q) for i, t, q in made(1, 120)]
    docs = [(1000 + i, t) for i, t in clean]
    docs += [(2000 + i, t) for i, t in clean[:10]]  # copies
    docs += [(3000 + i, t + " more words") for i, t in clean[10:20]]  # near copies
    docs += [(4000 + i, f"{prose(rng, 80)}\n{bench[i % 8][1]}\n{prose(rng, 80)}") for i in range(16)]
    docs += [(5000 + k, t) for k, t in enumerate(EDGES)] + [(None, prose(rng, 90)), (1000, prose(rng, 90))]
    table = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i else None, len(t or "")) for i, t in [(i, t) for i, t, _ in rows] + docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "pack":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept[name] = at.collect()
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert {1000 + i for i, _ in clean} <= ids("quality_rules") and not {5000, 5001, 5002, 5003} & ids("quality_rules")
    want = brute([(r.doc_id, r.text) for r in kept["quality_rules"]], lambda t: t.split("\n"), "\n", line_runs, lambda u: u)
    assert sorted(r.text for r in kept["line_dedup"]) == sorted(x for x in (want[r.doc_id, r.text][0] for r in kept["quality_rules"]) if x), "emptied ones are gone"
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    assert not {4000 + i for i in range(16)} & ids("decontaminate") and ids("decontaminate") >= {1000 + i for i, _ in clean if i >= 20}
    enc, tokens = encoder(), {}
    for r in kept["decontaminate"]:
        if r.text:
            tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len(enc.ids(r.text)) + 1
    packed = {}
    for r in kept["pack"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == tokens
    order = sorted((r for r in kept["decontaminate"] if r.text), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    if len({r.doc_id for r in order}) == len(order):
        assert sorted((r.window, r.position, r.n_tokens) for r in kept["pack"]) == sorted(x[2:] for x in packing.pack_lengths([len(enc.ids(r.text)) + 1 for r in order]))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect()), key=repr) == sorted(map(tuple, kept["pack"]), key=repr), "run gives what the stages give one by one"


def test_near_dedup_loses_no_pair_at_the_radius(spark, tmp_path):
    """Edited texts, many of them 40 to 48 bits off: of every group by brute force one document stays."""
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(80, 200)) for _ in range(200)]
    texts += [edited(rng, t, rng.uniform(0.1, 0.2)) for t in texts]
    fp = simhash.fingerprints(*simhash.doc_words(texts), len(texts))
    bits = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    assert (np.triu(bits >= 40, 1) & (bits <= simhash.RADIUS)).sum() > 50
    group = np.arange(len(texts))
    for _ in group:
        group = np.where(bits <= simhash.RADIUS, group[None], len(texts)).min(axis=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == np.unique(group).tolist()


def test_decisions_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = sum((i in kept) == bool(q) for i, q in truth.items())
    assert right >= 0.9 * len(truth) and quality.TRAIN_DOCS == 3000


def test_stages_take_empty_tables_and_any_columns(spark, tmp_path):
    names = "doc_id long, text string, _id int, _k string, _row int, _text int, _at string, `a.b` int, n long, shard int"
    rows = [(1, "one text of some words\nand lines", 1, "x", 1, 1, "x", 1, 1, 1), (None, None, None, None, None, None, None, None, None, None), (2, "", 2, "x", 2, 2, "x", 2, 2, 2)]
    spark.createDataFrame([(1, "an item of the benchmark, of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, names)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "pack":
                assert [r.doc_id for r in out.collect()] == [1][: len(given)]
            else:
                assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {1} & {r[0] for r in given}
    text = spark.createDataFrame(rows, names)
    assert sorted(r.text or "" for r in corpus_pipeline.line_dedup(spark, text, str(tmp_path)).collect()) == ["", "", rows[0][1]], "what was empty before stays"
