"""Line and sentence-span deduplication against plain Python, and the queries that have SQL against DuckDB."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import _repeats, linededup, queries, spandedup
from tests.llm.data import EDGES, frame, prose, rows_of
from tests.test_queries import SF, TABLES, same


def brute(rows, split, glue, runs, key):
    """{(id, text): text without later runs} of distinct rows; ``runs`` gives the (first, end) of a text's units, ``key`` what is compared."""
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        units, gone = split(text), set()
        for p, e in runs([key(u) for u in units]):
            run = tuple(key(u) for u in units[p:e])
            gone |= set(range(p, e)) if run in seen else set()
            seen.add(run)
        out[i, text] = (glue.join(u for p, u in enumerate(units) if p not in gone), len(gone))
    return out


def line_runs(units):
    return [(p, p + 3) for p in range(len(units) - 2) if "".join(units[p : p + 3]).strip(" ")]


def span_runs(units):
    out = []
    for p in range(len(units)):
        e, n = p, 0
        while e < len(units) and (e - p < spandedup.SENTENCES or n < spandedup.MIN_CHARS):
            n, e = n + len(units[e]), e + 1
        if e - p >= spandedup.SENTENCES and n >= spandedup.MIN_CHARS:
            out.append((p, e))
    return out


def corpus(seed, sentence_end):
    """Texts that share passages, some of them several times, with unique ids."""
    rng = random.Random(seed)
    passages = [[prose(rng, rng.randint(3, 12)).rstrip(".") for _ in range(rng.randint(2, 7))] for _ in range(6)]
    rows = [(None, sentence_end.join(passages[0]))]
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [prose(rng, rng.randint(2, 9)).rstrip(".")]
            if rng.random() < 0.2:
                parts += ["", " ", ""]
        rows.append((i, sentence_end.join(parts)))
    return rows + [(100 + k, t) for k, t in enumerate(EDGES)] + [(200, sentence_end.join(["same"] * 9)), (5, rows[6][1]), (201, sentence_end.join(f"long sentence number {k} of a very long text" for k in range(3000)))]


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_runs_of_one_task_are_sifted(most):
    """Whatever a task remembers of hashes it has met, the runs that aren't the first of their hash come out, copies of the first excepted."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 9 == 0 else int(i), int(1000 + i // 2), int(p), int(rng.integers(0, 25))) for i in rng.permutation(120) for p in range(4)]
    seen, out = _repeats.Seen(most), []
    for at in range(0, len(rows), 40):  # batches of ten documents
        part = rows[at : at + 40]
        ids, k = pa.array([r[0] for r in part[::4]], pa.int64()), pa.array([r[1] for r in part[::4]], pa.int64())
        h = np.asarray([r[3] for r in part], dtype=np.int64)
        out += seen.sifted(ids, k, np.repeat(np.arange(10), 4), np.tile(np.arange(4), 10), np.ones(40, dtype=np.int64), h * 7, (h % 5).astype(np.int32))
    table = pa.Table.from_batches(out)
    order = sorted(range(table.num_rows), key=lambda i: tuple((x is not None, x or 0) for x in (table[c][i].as_py() for c in ("_h1", "_h2", "_id", "_k", "_pos"))))
    batches = table.take(order).combine_chunks().to_batches(max_chunksize=17)
    got = {(r["_id"], r["_k"], r["_pos"]) for b in _repeats.not_first(iter(batches)) for r in b.to_pylist()}
    first = {}
    for i, k, p, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        first.setdefault(h, (i, k, p))
    assert got == {(i, k, p) for i, k, p, h in rows if (i, k, p) != first[h]}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = corpus(seed, "\n")
    want = brute(rows, lambda t: t.split("\n"), "\n", line_runs, lambda u: u)
    got = linededup.dedup_lines(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert rows_of(got, "doc_id", "text") == sorted(((i, t if t is None else want[i, t][0]) for i, t in rows), key=repr)
    counted = linededup.dedup_lines(frame(spark, rows), removed="gone")
    assert rows_of(counted) == sorted(((i, t, 0) if t is None else (i, *want[i, t]) for i, t in rows), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_spans(spark, seed):
    rows = corpus(seed, ". ")
    want = brute(rows, spandedup.sentences, "", span_runs, lambda u: u.strip(" \t\r\n").lower())
    got = spandedup.dedup_spans(frame(spark, rows))
    assert rows_of(got, "doc_id", "text") == sorted(((i, t if t is None else want[i, t][0]) for i, t in rows), key=repr)


def test_ties_and_copies(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\na\nb\nc"), (2, "a\nb\nc\nd")]
    got = rows_of(linededup.dedup_lines(frame(spark, rows)), "doc_id", "text")
    assert got.count((1, "a\nb\nc")) + got.count((1, "")) >= 2 and (2, "d") in got and len(got) == 4, "copies of a row come out alike"
    assert sum("a\nb\nc" in t for _, t in set(got)) == 1, "one text keeps the window"
    for dedup in (linededup.dedup_lines, spandedup.dedup_spans):
        assert dedup(frame(spark, [])).isEmpty()


def test_passages_from_the_middle_of_sentences(spark):
    """Passages of over 50 words, pasted into other texts at any word; a short line in all texts stays."""
    rng = random.Random(11)
    texts = [prose(rng, 300) for _ in range(60)]
    line = "A short line of few words."
    rows = [(i, f"{line}\n{t}") for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:40]):
        w, at = t.split(" "), rng.randrange(0, 200)
        host = prose(rng, 120).split(" ")
        rows.append((100 + i, " ".join(host[:60] + w[at : at + 55] + host[60:])))
    rows.append((300, "".join(f"这是第{k}个很长的句子，里面有许多不同的字。" for k in range(40))))
    rows.append((301, "".join(f"这是第{k}个很长的句子，里面有许多不同的字。" for k in range(5, 30)) + "结尾。"))
    got = {r.doc_id: r.n for r in spandedup.dedup_spans(frame(spark, rows), removed="n").collect()}
    assert sum(got[100 + i] > 0 for i in range(40)) >= 36 and got[301] > 30
    assert not any(got[i] for i in range(60)) and not got[300]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])
