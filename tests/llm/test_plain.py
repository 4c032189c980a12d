"""Sharding, packing, token output and chat windows against plain definitions."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import chat, packing, queries, sharding, tokenout
from loomgraph.llm._tokens import END_OF_TEXT, encoder
from tests.llm.data import EDGES, frame, prose, rows_of


def slow_table(shards, size):
    """Turn by turn, each shard's next free slot in its order of preference."""
    orders = []
    for s in shards:
        offset, skip = sharding.preference(s, size)
        orders.append([(offset + j * skip) % size for j in range(size)])
    table, turn = {}, 0
    while len(table) < size:
        table[next(x for x in orders[turn % len(shards)] if x not in table)] = turn % len(shards)
        turn += 1
    return [table[i] for i in range(size)]


@pytest.mark.parametrize("n,size", [(1, 2), (3, 13), (7, 101), (10, 11)])
def test_lookup_table(n, size):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(shards, size)
    assert table.tolist() == slow_table(shards, size)
    share = np.bincount(table, minlength=n)
    assert share.max() - share.min() <= 1


def test_lookup_table_rejects():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_few_keys_move_when_a_shard_leaves():
    old, new = sharding.lookup_table(sharding.SHARDS), sharding.lookup_table(sharding.SHARDS[:-1])
    assert ((old != new) & (old != len(sharding.SHARDS) - 1)).mean() < 0.1


def test_assign_shards(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "x"), (3, "again"), (None, None)]
    got = rows_of(sharding.assign_shards(frame(spark, rows)))
    assert len(got) == len(rows) and len({s for k, *s in [(r[0], r[1], r[2]) for r in got if r[0] is None] for s in [tuple(s)]}) == 1
    monkeypatch.setattr(sharding, "ARRAY_SLOTS", 1)
    assert rows_of(sharding.assign_shards(frame(spark, rows))) == got, "a joined table places alike"
    assert sharding.assign_shards(frame(spark, [])).columns == ["doc_id", "slot", "shard"] and sharding.assign_shards(frame(spark, [])).isEmpty()


def slow_pack(lengths, window):
    """The rule with the sum of squares computed in full for each choice."""
    open_, out, count = [], [], 0
    for doc, length in enumerate(lengths):
        for piece, start in enumerate(range(0, length, window)):
            size = min(window, length - start)
            counts = {}
            for level, _ in open_:
                counts[level] = counts.get(level, 0) + 1

            def after(level):
                c = dict(counts)
                if level:
                    c[level] -= 1
                if level + size < window:
                    c[level + size] = c.get(level + size, 0) + 1
                return sum(v * v for v in c.values())

            options = [0, *(h for h in counts if h + size <= window)]
            best = min(options, key=lambda h: (after(h), -h)) if size < window else 0
            if best:
                at = max(i for i, (h, _) in enumerate(open_) if h == best)
                w = open_.pop(at)[1]
            else:
                w, count = count, count + 1
            out.append((doc, piece, w, best, size))
            if best + size < window:
                open_.append((best + size, w))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40), st.integers(2, 16))
def test_packing_rule(lengths, window):
    assert packing.pack_lengths(lengths, window) == slow_pack(lengths, window)


def test_pack_documents(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 300))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(EDGES)] + [(5, "other text"), (None, "no id"), (7, "twice"), (7, "twice")]
    got = packing.pack_documents(frame(spark, rows), window=128, packer_tokens=4000).collect()
    enc, windows = encoder(), {}
    for r in got:
        windows.setdefault((r.packer, r.window), []).append((r.position, r.n_tokens))
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 128
    want = {}
    for i, t in rows:
        if t:
            want[i] = want.get(i, 0) + len(enc.ids(t)) + 1
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
    assert have == want and len({r.packer for r in got}) > 1
    by = {}
    for r in packing.pack_documents(frame(spark, rows[:60]), window=128).collect():
        by[r.doc_id, r.piece] = (r.window, r.position, r.n_tokens)
    lengths = [len(enc.ids(t)) + 1 for _, t in rows[:60]]
    assert by == {(d, p): (w, at, n) for d, p, w, at, n in packing.pack_lengths(lengths, 128)}
    assert packing.pack_documents(frame(spark, [])).isEmpty() and packing.pack_documents(frame(spark, [(1, None), (2, "")])).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    o = tokenout.order(n)
    slots = tokenout.permute(np.arange(n), o)
    assert sorted(slots.tolist()) == list(range(n)) and tokenout.permute(slots, o, back=True).tolist() == list(range(n))
    if n >= 1000:
        assert tokenout.permute(np.arange(n), tokenout.order(n, "other")).tolist() != slots.tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def stream_of(rows):
    """The ids of every row, whole: what each row's stretches must add up to."""
    enc = encoder()
    return sorted(((i, (*enc.ids(t).tolist(), END_OF_TEXT)) for i, t in rows if t), key=repr)


def documents_in(got, length):
    """Walk the sequences by number, undoing the permutation with plain steps, and cut the stream at the ends of documents."""
    total = max(r.slot for r in got) + 1
    slot_of = tokenout.permute(np.arange(total), tokenout.order(total)).tolist()
    assert sorted(slot_of) == list(range(total))
    number = {s: k for k, s in enumerate(slot_of)}
    out, open_ = [], None
    for r in sorted(got, key=lambda r: number[r.slot] * length * 2 + r.offset % (length * 2)):
        ids = np.frombuffer(r.tokens, "<u2").tolist()
        assert len(ids) == r.n_tokens and (r.piece == 0) == (open_ is None)
        open_ = (r.doc_id, (*(open_[1] if open_ else ()), *ids))
        if ids[-1] == END_OF_TEXT:
            out.append(open_)
            open_ = None
    assert open_ is None
    return sorted(out, key=repr)


def test_token_output_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(EDGES)] + [(3, "second text of 3"), (None, "no id"), *[(7, "again")] * 40]
    got = tokenout.written_sequences(frame(spark, rows), f"file://{tmp_path}/shards", length=32, shard_sequences=16).collect()
    assert documents_in(got, 32) == stream_of(rows)
    assert all(r.shard == r.slot // 16 and r.offset // 64 == r.slot % 16 for r in got)
    total = max(r.slot for r in got) + 1
    whole = tokenout.read_slots(f"file://{tmp_path}/shards", 0, total + 5, 32, 16)
    assert len(whole) == total == -(-sum(len(x) for _, x in stream_of(rows)) // 32), "no fill but in the last sequence"
    for r in got:
        a = r.offset % 64 // 2
        assert whole[r.slot][a : a + r.n_tokens].tobytes() == r.tokens
    assert tokenout.read_slots(f"file://{tmp_path}/shards", 13, 9, 32, 16).tolist() == whole[13:22].tolist(), "a read may begin and end anywhere"
    for shard in range(-(-total // 16)):
        path = f"{tmp_path}/shards/shard-{shard:06d}.bin"
        assert open(path + ".sha256").read().split() == [hashlib.sha256(open(path, "rb").read()).hexdigest(), f"shard-{shard:06d}.bin"]
    assert tokenout.written_sequences(frame(spark, [])).isEmpty() and tokenout.written_sequences(frame(spark, [(1, None), (2, "")])).isEmpty()


def test_training_order_is_the_same_for_other_partitions(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 300))) for i in range(60)] + [(4, "another text"), (9, "twice"), (9, "twice")]
    places = [rows_of(tokenout.written_sequences(frame(spark, rows).repartition(n), length=64, shard_sequences=8), "doc_id", "piece", "slot", "offset", "n_tokens") for n in (1, 3, 7)]
    assert places[0] == places[1] == places[2]
    other = rows_of(tokenout.written_sequences(frame(spark, rows), length=64, shard_sequences=8, key="another key"), "doc_id", "piece", "slot", "offset", "n_tokens")
    assert other != places[0]


def test_shards_need_a_file_system(spark):
    with pytest.raises(Exception, match="nowhere"):
        tokenout.written_sequences(frame(spark, [(1, "a text")]), "nowhere://bucket/shards").collect()


def test_token_output_query_writes_its_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 3000))) for i in range(30)] + [(100 + i, t) for i, t in enumerate(EDGES)] + [(None, "no id")]
    frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_token_output(spark, str(tmp_path)).collect()
    assert documents_in(got, tokenout.LENGTH) == stream_of(rows)
    whole = open(got[0].path.removeprefix("file://"), "rb").read()
    assert len({r.path for r in got}) == 1 and len(whole) == (max(r.slot for r in got) + 1) * tokenout.LENGTH * 2
    assert all(r.tokens == whole[r.offset : r.offset + 2 * r.n_tokens] for r in got)


def test_chat_windows(spark):
    rng = random.Random(3)
    rows, cid = [], 0
    for cid in range(25):
        turns = ([("system", prose(rng, rng.choice([5, 60])))] if cid % 3 else []) + [(("user", "assistant")[k % 2], prose(rng, rng.choice([3, 20, 120]))) for k in range(rng.randint(0, 9))]
        rows += [(cid, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(50, 0, None, "x"), (50, 1, "user", None), (51, None, "user", "first"), (51, 1, "assistant", ""), (52, 0, "user", "twice"), (52, 0, "user", "twice"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, window int, mask string")
    got = chat.chat_windows(df, budget=100, history=30).collect()
    enc, by = encoder(), {}
    for r in sorted(got, key=lambda r: (repr(r.conv_id), r.window)):
        by.setdefault(r.conv_id, []).append(r)
    assert 50 not in by and None in by
    for i, windows in by.items():
        turns = sorted({(t if t is not None else -1, role, text) for c, t, role, text in rows if c == i and role is not None and text is not None})
        ids = [(role, [*enc.ids(f"<{role}>\n{text}"), END_OF_TEXT]) for _, role, text in turns]
        system = ids[0][1][:50] if ids and ids[0][0] == "system" else []
        rest = [x for x in ids if x[0] != "system"]
        targets = []
        for r in windows:
            tokens, mask = np.frombuffer(r.tokens, "<u2").tolist(), np.frombuffer(r.mask, "u1").tolist()
            assert len(tokens) == len(mask) == r.n_tokens <= 100 and sum(mask) == r.n_targets and tokens[: len(system)] == system and not any(mask[: len(system)])
            body = [x for _, t in rest[r.first_turn : r.end_turn] for x in t]
            room = 100 - len(system)
            whole = [x for role, t in ids if role == "system" for x in t]
            if r.end_turn == 0 and len(whole) > 50:  # the rest of a long system turn
                body = whole[50:]
            assert tokens[len(system) :] == body[r.part * room : (r.part + 1) * room]
            assert sum(len(t) for _, t in rest[r.first_turn : r.new_turn]) <= 30
            targets += [x for x, m in zip(tokens, mask) if m]
        assert targets == [x for role, t in rest if role == "assistant" for x in t], "every target once, in order"
        new = [(r.new_turn, r.end_turn) for r in windows if r.part == 0 and r.end_turn]
        assert [a for a, _ in new] == [0, *(b for _, b in new[:-1])][: len(new)]
    assert chat.chat_windows(df.limit(0)).isEmpty()


def test_copies_and_null_ids_spread_over_packers(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 10)
    same = [(7, "one text of some words, again and again")] * 400
    got = packing.pack_documents(frame(spark, same), window=128, packer_tokens=400).collect()
    assert len(got) == 400 and len({r.packer for r in got}) > 5
    nulls = [(None, f"text number {i} without an id") for i in range(200)]
    got = packing.pack_documents(frame(spark, nulls), window=128, packer_tokens=100).collect()
    assert len(got) == 200 and len({r.packer for r in got}) > 5


def test_chat_query_keeps_whole_system_turns(spark, tmp_path):
    rng, enc = random.Random(5), encoder()
    systems = {1: [prose(rng, 900)], 2: [prose(rng, 900)], 3: [prose(rng, 200), prose(rng, 200)], 4: [prose(rng, 5)], 5: []}
    rows = [(c, k, "system", t) for c, ts in systems.items() for k, t in enumerate(ts)]
    talk = [(c, 10 + k, ("user", "assistant")[k % 2], prose(rng, 90)) for c in (2, 3, 4, 5) for k in range(6)]
    spark.createDataFrame(rows + talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = {}
    for r in sorted(queries.op6_chat_windows(spark, str(tmp_path)).collect(), key=lambda r: (r.conv_id, r.window)):
        by.setdefault(r.conv_id, []).append((r, np.frombuffer(r.tokens, "<u2").tolist(), np.frombuffer(r.mask, "u1").tolist()))
    assert sorted(by) == [1, 2, 3, 4, 5]
    for c, windows in by.items():
        system = [x for t in systems[c] for x in [*enc.ids(f"<system>\n{t}"), END_OF_TEXT]]
        head, tails = system[: chat.BUDGET // 2], [(t, m) for r, t, m in windows if r.end_turn == 0]
        assert all(len(t) <= chat.BUDGET and t[: len(head)] == head for _, t, _ in windows)
        assert head + [x for t, _ in tails for x in t[len(head) :]] == system or not tails and head == system, "every token of the system turn"
        assert not any(any(m) for _, m in tails) and [r.part for r, _, _ in windows if r.end_turn == 0] == list(range(len(tails)))
        assert [x for _, t, m in windows for x, on in zip(t, m) if on] == [x for n, _, role, t in talk if n == c and role == "assistant" for x in [*enc.ids(f"<assistant>\n{t}"), END_OF_TEXT]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=12), st.integers(0, 20), st.integers(0, 30))
def test_window_rule(sizes, system, history):
    """New turns are taken while they fit; history is the longest run of turns before them within both limits."""
    budget, start = 64, 0
    for w in chat.windows(sizes, system, budget, history):
        room = budget - system
        assert w.start == start and w.end > w.start
        runs = [f for f in range(start + 1) if sum(sizes[f:start]) <= history and sum(sizes[f : start + 1]) <= room]
        assert w.history == (min(runs) if runs else start)
        fits = [e for e in range(start + 1, len(sizes) + 1) if sum(sizes[w.history : e]) <= room]
        assert w.end == (max(fits) if fits else start + 1)
        start = w.end
    assert start == len(sizes)
