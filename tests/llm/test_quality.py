"""The line field: decoding and gradients against brute force, and what it keeps."""

import itertools
import random

import numpy as np
from loomgraph.llm import quality
from tests.llm.data import EDGES, frame, prose, rows_of


def random_field(rng):
    return quality.Field(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)), 0.5)


def test_viterbi_against_all_paths():
    rng, words = np.random.default_rng(1), random.Random(1)
    texts = [None, "", "a\n\nb"] + ["\n".join(words.choice(["Some text here.", "| | |", "BUY!!!", "", "12 34"]) for _ in range(words.randint(1, 8))) for _ in range(30)]
    lines = quality.line_features(texts)
    field = random_field(rng)
    got = quality.viterbi(lines, field)
    for t in range(len(texts)):
        a, b = lines.bounds[t], lines.bounds[t + 1]
        e = lines.x[a:b] @ field.w
        score = lambda path: sum(e[k] for k, s in enumerate(path) if s) + sum(field.t[s, u] for s, u in zip(path, path[1:]))  # noqa: E731, B023
        if b > a:
            best = max(score(p) for p in itertools.product((0, 1), repeat=int(b - a)))
            assert abs(score(got[a:b].astype(int).tolist()) - best) < 1e-9
    assert lines.bounds[1] == 0 and lines.bounds[2] == 1, "a null text has no line, an empty one a blank line"


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    bounds = np.asarray([0, 3, 4, 9])
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    w, t = rng.normal(size=4), rng.normal(size=(2, 2))

    def likelihood(w, t):
        total = 0.0
        for a, b in zip(bounds, bounds[1:]):
            e = x[a:b] @ w
            score = lambda p: sum(e[k] for k, s in enumerate(p) if s) + sum(t[s, u] for s, u in zip(p, p[1:]))  # noqa: E731, B023
            total += score(y[a:b].astype(int).tolist()) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=int(b - a))))
        return total

    g, gt = quality._likelihood(x, y, bounds, w, t)
    step = 1e-6
    for k in range(4):
        d = np.eye(4)[k] * step
        assert abs((likelihood(w + d, t) - likelihood(w - d, t)) / (2 * step) - g[k]) < 1e-5
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = step
        assert abs((likelihood(w, t + d) - likelihood(w, t - d)) / (2 * step) - gt[i, j]) < 1e-5


def junk(rng):
    return "\n".join(rng.choice(["CLICK HERE NOW!!! $$$ BUY BUY BUY", "| a | b | c | d |", "Home | About | Login | Share", "#### 1234 5678 ####", "buy buy buy buy buy"]) for _ in range(rng.randint(3, 15)))


def made(seed, n):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(30, 200)).replace(". ", ".\n"), 1) if i % 2 else (i, junk(rng), 0) for i in range(n)]


def test_held_out_accuracy_and_stage(spark):
    train, held = made(1, 200), made(2, 100)
    rows = [(i, t) for i, t, _ in train]
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in train] + [(None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    field = quality.fit(frame(spark, rows), labels)
    again = quality.fit(frame(spark, rows), labels)
    assert (field.w == again.w).all() and (field.t == again.t).all(), "training is deterministic"
    extra = [(1000 + k, t) for k, t in enumerate(EDGES)] + [(None, held[1][1]), (3, held[3][1])]
    docs = frame(spark, [(i, t) for i, t, _ in held] + extra)
    got = {(r.doc_id, r.content_share, r.kept) for r in quality.assess(docs, field).collect()}
    kept = {i for i, _, k in got if k}
    assert sum((i in kept) == bool(q) for i, _, q in held) >= 0.95 * len(held)
    assert {i for i, t in extra if not (t or "").strip()} & kept == set(), "nothing to keep in empty texts"
    out = quality.keep_content(docs, field)
    assert out.columns == docs.columns and rows_of(out, "doc_id") == sorted(((i,) for i, s, k in quality.assess(docs, field).select("doc_id", "content_share", "kept").collect() if k), key=repr)
    shares = dict((r.doc_id, (r.lines, r.content_lines, r.content_share)) for r in quality.assess(docs, field).filter("doc_id < 100 AND doc_id <> 3").collect())
    for i, t, _ in held:
        if i != 3:
            lines = quality.line_features([t])
            good = ~quality.viterbi(lines, field)
            assert shares[i] == (len(good), int(good.sum()), float(lines.size[good].sum() / lines.size.sum()))


def test_labels_of_one_kind_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "CLICK!!!"), (2, None)])
    for labels in (none, ones):
        field = quality.fit(docs, labels)
        assert rows_of(quality.keep_content(docs, field), "doc_id") == [(1,)], "without two labels every line is content"
    assert quality.keep_content(frame(spark, []), quality.fit(frame(spark, []), none)).isEmpty()


def test_training_sample_is_bounded(spark):
    train = made(4, 60)
    docs = frame(spark, [(i, t) for i, t, _ in train])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in train], "doc_id long, quality int, toxic int")
    small = quality.fit(docs, labels, train_docs=20)
    assert small.w.shape == (len(quality.FEATURES),) and not np.array_equal(small.w, quality.fit(docs, labels).w)


def test_very_long_texts_are_decoded_whole(spark):
    rng = random.Random(9)
    long = "\n".join(prose(rng, 12) for _ in range(16_000))
    assert len(long) > 1_000_000
    field = quality.train([t for _, t, _ in made(2, 80)], [not q for _, _, q in made(2, 80)])
    got = {r.doc_id: r for r in quality.assess(frame(spark, [(1, long), (2, "x " * 700_000), (3, None)]), field).collect()}
    assert got[1].lines == 16_000 and got[1].kept and got[2].lines == 1 and not got[3].kept
