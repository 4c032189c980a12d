"""Near-duplicates, decontamination and license scans against brute force."""

import random

import numpy as np
import pytest
from loomgraph.llm import decontam, licenses, simhash
from loomgraph.llm._rows import packed
from loomgraph.llm._text import span_hash, words
from loomgraph.operators.tables import staged
from tests.llm.data import EDGES, frame, prose, rows_of


def test_words():
    texts = ["Hello, wörld 42!", None, "", "x" * 1000 + " y", "hello HELLO", "a" * 8 + " " + "a" * 9 + " " + "a" * 16]
    w = words(texts)
    assert w.doc.tolist() == [0, 0, 0, 3, 3, 4, 4, 5, 5, 5] and w.hash[0] == w.hash[5] == w.hash[6] and len(set(w.hash.tolist())) == 8
    for t in range(len(texts)):
        assert words([texts[t]]).hash.tolist() == w.hash[w.doc == t].tolist(), "a hash doesn't depend on the batch"
    assert len(words([]).hash) == 0 and len(words([None, ""]).hash) == 0
    data = np.frombuffer(b"ab\0ab", dtype=np.uint8)
    h = span_hash(data, np.asarray([0, 3, 0, 2]), np.asarray([2, 5, 3, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def edited(rng, text, share):
    return " ".join(rng.choice(["zz", "yy", w + "x"]) if rng.random() < share else w for w in text.split(" "))


def near_corpus(seed):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 250)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(0, 60, 3):
        rows += [(100 + i, base[i]), (200 + i, edited(rng, base[i], 0.02)), (300 + i, edited(rng, base[i], 0.05))]
    return rows + [(1000 + k, t) for k, t in enumerate(EDGES)] + [(1100 + k, t) for k, t in enumerate(EDGES)] + [(3, base[3]), (3, base[3]), (None, base[7]), (4, "another text of document four, of its own")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_corpus(seed)
    docs = frame(spark, rows)
    work = packed(docs)
    prints = {(r["_id"], r["_k"]): r["_fp"] for r in simhash.fingerprint_docs(work).collect()}
    items = sorted(set(prints.values()))
    fp = np.frombuffer(b"".join(items), dtype=np.uint64).reshape(len(items), -1)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= simhash.RADIUS
    links = {x: int(n) - 1 for x, n in zip(items, near.sum(axis=1))}
    distinct = spark.createDataFrame([(x,) for x in items], "_fp binary")
    rows_found = simhash.near_fingerprints(distinct).collect()
    have = {}
    for r in rows_found:
        have[r["b"]] = have.get(r["b"], 0) + r["links"]
    assert all(n <= links[x] for x, n in have.items()) and sum(have.values()) >= 0.9 * sum(links.values())
    found = [(r["a"], r["b"]) for r in rows_found]

    parent = {x: x for x in items}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in found:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    keyed = work.select("_id", "_k").collect()
    groups = {}
    for r in keyed:
        if (r["_id"], r["_k"]) in prints:
            groups.setdefault(root(prints[r["_id"], r["_k"]]), []).append((r["_id"] is not None, r["_id"] or 0, r["_k"], r["_id"]))
    linked = {x: root(x) for x in items}
    missed = sum(linked[items[i]] != linked[items[j]] for i, j in np.argwhere(np.triu(near, 1)))
    assert missed <= 0.05 * np.triu(near, 1).sum(), "near pairs are in one group"
    want = [(x[3], min(g)[3], len(g), have.get(prints[x[3], x[2]], 0)) for g in groups.values() if len(g) > 1 for x in sorted(g)[1:]]
    assert rows_of(simhash.near_duplicates(docs)) == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(want)
    assert sum(r.text in (None, "", " ", "\n\n\n", "?!") for r in kept.collect()) == 10, "texts without words all stay"
    got = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(docs).collect()}
    assert all(got.get(100 + i) is not None or i == 7 for i in range(0, 60, 3)) and sum(200 + i in got for i in range(0, 60, 3)) >= 18, "copies and near copies are found"
    clean = {i for i in range(60) if i % 3 and i != 7}
    assert not clean & set(got), "others are left alone"


def flipped(rng, fp, bits):
    """Copies of fingerprints with so many random bits flipped."""
    out = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1)
    for row, n in zip(out, bits):
        row[rng.choice(simhash.BITS, n, replace=False)] ^= 1
    return np.packbits(out, axis=1).view(np.uint64)


@pytest.mark.parametrize("chunk", [150, simhash.CHUNK])
def test_no_pair_at_the_radius_is_lost(spark, chunk):
    """400 pairs at 40 to 48 bits and 50 just beyond: all of the former are linked, none of the latter."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 64, (450, 4), dtype=np.uint64)
    bits = np.concatenate([rng.integers(40, simhash.RADIUS + 1, 200), np.full(200, simhash.RADIUS), np.full(50, simhash.RADIUS + 1)])
    b = flipped(rng, a, bits)
    rows = simhash.near_fingerprints(spark.createDataFrame([(x.tobytes(),) for x in np.concatenate([a, b])], "_fp binary"), chunk=chunk)
    got = {r["b"]: r["n"] for r in rows.groupBy("b").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    assert got == {x.tobytes(): 1 for x in np.concatenate([a[:400], b[:400]])}
    other = {x.tobytes(): y.tobytes() for x, y in zip(a[:400], b[:400])}
    assert dict(rows_of(simhash.components(rows.select("a", "b")))) == {max(p): min(p) for p in other.items()}


@pytest.mark.parametrize("items, radius", [(10, 48), (1 << 17, 48), (1 << 19, 20), (1 << 14, 60), (300, 3), (300, 0)])
def test_each_near_pair_comes_from_one_block(items, radius):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 64, (300, 4), dtype=np.uint64)
    fp = np.unique(np.concatenate([base, flipped(rng, base, rng.integers(1, 70, 300)), flipped(rng, base[:3].repeat(20, axis=0), rng.integers(1, 40, 60))]), axis=0)
    plan = simhash.blocks_plan(items, radius)
    assert sum(most + 1 for _, _, most in plan) == radius + 1 and simhash.popcount(np.bitwise_or.reduce(simhash.block_masks(plan))[None])[0] == sum(e - s for s, e, _ in plan)
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= radius, 1))}
    for at in (None, 250):
        found = [simhash.near_pairs(fp[:at], None if at is None else fp[at:], plan, k, radius) for k in range(len(plan))]
        got = [(int(i), int(j) + (at or 0)) for some in found for lot in some for i, j in zip(*lot)]
        assert sorted((min(p), max(p)) for p in got) == sorted((i, j) for i, j in want if at is None or i < at <= j)


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "")], [(1, "one text")]):
        assert simhash.near_duplicates(frame(spark, rows)).isEmpty() and simhash.drop_near_duplicates(frame(spark, rows)).count() == len(rows)


def test_components(spark):
    chain = [(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(40)] + [(b"\x10\x00", b"\x10\x01"), (b"\x10\x01", b"\x10\x00"), (b"\x20\x00", b"\x20\x00")]
    got = dict(rows_of(simhash.components(spark.createDataFrame(chain, "a binary, b binary"))))
    assert got == {i.to_bytes(2, "big"): b"\0\0" for i in range(1, 41)} | {b"\x10\x01": b"\x10\x00"}


@pytest.mark.parametrize("items", [10_000, 1_000_000, 100_000_000])
def test_keys_reach_the_radius(items):
    """Pairs at the largest distance that counts, and at the close one, meet in some table."""
    rng = np.random.default_rng(3)
    _, positions = simhash.key_plan(items)
    for bits, least in ((simhash.RADIUS, 0.87), (simhash.CLOSE, 0.95)):
        met = 0
        for _ in range(1000):
            differs = np.zeros(simhash.BITS, dtype=bool)
            differs[rng.choice(simhash.BITS, bits, replace=False)] = True
            met += not differs[positions].any(axis=1).all()
        assert met >= least * 1000, (items, bits, met)


def test_fingerprints_are_majorities():
    """Bit by bit, for few and for many words."""
    rng = random.Random(1)
    texts = [None, "one", prose(rng, 40), "", prose(rng, 3000), prose(rng, 700)]
    doc, h = simhash.doc_words(texts)
    fp = simhash.fingerprints(doc, h, len(texts))
    for t in range(len(texts)):
        for lane in range(4):
            bits = np.unpackbits(simhash.mix64(h[doc == t] + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1)
            assert (np.unpackbits(fp[t, lane : lane + 1].view(np.uint8)) == (2 * bits.sum(axis=0, dtype=int) > len(bits))).all()


def test_pivots_discard_no_near_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, (200, 4), dtype=np.uint64)
    b = a.copy()
    for r in range(200):
        for bit in rng.choice(256, rng.integers(0, 90), replace=False):
            b[r, bit // 64] ^= np.uint64(1 << (int(bit) % 64))
    key = np.repeat(np.arange(200), 2)
    fp = np.stack([a, b], axis=1).reshape(400, 4)
    got = simhash.compared(key, fp, simhash.key_masks(simhash.key_plan(100)[1]), simhash.RADIUS)
    near = np.bitwise_count(a ^ b).sum(axis=1) <= simhash.RADIUS
    assert ((got.root[0::2] == got.root[1::2]) == near).all() and (got.links == np.repeat(near, 2)).all()


def test_pivots_discard_far_pairs(spark):
    """Nearly all pairs of unrelated texts go before their full fingerprints are compared."""
    rng = random.Random(8)
    docs = frame(spark, [(i, prose(rng, rng.randint(60, 400))) for i in range(300)])
    fp = np.frombuffer(b"".join(r["_fp"] for r in simhash.fingerprint_docs(packed(docs)).collect()), dtype=np.uint64).reshape(-1, 4)
    table = simhash.pivot_table(fp)
    i, j = np.triu_indices(len(fp), 1)
    far = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) > simhash.RADIUS
    assert far.mean() > 0.99 and (~simhash.possible(table, i, j))[far].mean() > 0.9


def test_hot_buckets_are_cut(spark):
    """With tiny chunks every bucket is compared chunk against chunk; the links are the same."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 64, (6, 4), dtype=np.uint64)
    fp = np.repeat(base, 30, axis=0)
    for r in range(len(fp)):
        for bit in rng.choice(256, rng.integers(0, 40), replace=False):
            fp[r, bit // 64] ^= np.uint64(1 << (int(bit) % 64))
    df = spark.createDataFrame([(x.tobytes(),) for x in fp], "_fp binary").distinct()
    def summed(chunk):
        rows = simhash.near_fingerprints(df, chunk=chunk)
        return rows_of(rows.groupBy("b").agg({"links": "sum"})), rows_of(simhash.components(rows.select("a", "b")))
    assert summed(7) == summed(1 << 14)



def paraphrase(rng, text, keep, noise):
    out = []
    for w in text.split():
        if rng.random() < keep:
            out.append(w)
        if rng.random() < noise:
            out.append(f"noise{rng.randint(0, 99)}")
    return " ".join(out)


def contaminated_corpus():
    rng = random.Random(9)
    bench = [(i, prose(rng, rng.randint(18, 58))) for i in range(30)]
    rows, planted = [], set()
    for i in range(150):
        text = prose(rng, rng.randint(20, 400))
        if i % 3 == 0:
            b = rng.randrange(30)
            inside = [bench[b][1], bench[b][1].upper(), paraphrase(rng, bench[b][1], 0.85, 0.2)][i % 9 // 3]
            at = rng.randint(0, len(text))
            text = f"{text[:at]} {inside} {text[at:]}"
            planted.add((i, b))
        rows.append((i, text))
    return bench, rows, planted


def test_decontamination(spark, monkeypatch):
    bench, rows, planted = contaminated_corpus()
    rows += [(200 + k, t) for k, t in enumerate(EDGES)] + [(0, rows[0][1]), (None, bench[3][1]), (300, prose(random.Random(1), 30000) + " " + bench[5][1])]
    docs = frame(spark, rows)
    table = spark.createDataFrame([*bench, (None, "no id"), (40, None), (41, ""), (42, "?!"), bench[0]], "item_id long, text string").selectExpr("*", "1 AS _id", "'x' AS term")
    got = decontam.contaminated(docs, table)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    # Brute force: every block and pair of blocks against every item, without the latent space.
    items = decontam.read_items(table)[0]
    held = staged(decontam.benchmark_words(packed(docs), items.vocab), "words").collect()
    brute = set()
    for r in held:
        p, t = np.frombuffer(r["pos"], "<i4"), np.frombuffer(r["term"], "<i4")
        for i, word in enumerate(items.terms):
            reach = len(word) * 3 // 2
            for block in sorted(set((p // decontam.BLOCK).tolist())):
                a, z = np.searchsorted(p, (block * 32 - reach, (block + 2) * 32 + reach))
                if np.isin(word, t[a:z]).mean() >= decontam.COVERED:
                    covered, answered = decontam.check(word, t[a:z])
                    if covered >= decontam.COVERED and answered >= decontam.ANSWERED:
                        brute.add((r["_id"], items.ids[i].as_py()))
                        break
    assert found <= brute and len(found & brute) >= 0.9 * len(brute)
    assert len(planted & found) >= 0.95 * len(planted) and (None, 3) in found and (300, 5) in found
    bad = {i for i, _ in found}
    assert len(bad - {i for i, _ in planted} - {None, 300}) <= 1, "clean documents are left alone"
    assert sum(r.doc_id == 0 for r in got.collect()) == 2 * len({b for i, b in found if i == 0}), "repeated rows come out alike"
    kept = decontam.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "text") == sorted((r for r in rows if r[0] not in bad), key=repr)
    monkeypatch.setattr(decontam, "ITEMS", 11)
    parts = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, table).collect()}
    assert len(parts & brute) >= 0.9 * len(brute) and parts <= brute, "a benchmark in parts"


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    for rows, b in (([], bench), ([(1, "some words of an item here")], bench.limit(0)), ([(1, None), (2, "")], bench)):
        assert decontam.contaminated(frame(spark, rows), b).isEmpty() and decontam.drop_contaminated(frame(spark, rows), b).count() == len(rows)


def test_decontamination_of_frequent_and_short_items(spark):
    rng = random.Random(12)
    bench = [(i, prose(rng, rng.randint(18, 40)).lower()) for i in range(12)] + [(20, "zora plim quent vask dorn hest"), (21, "brisk otter"), (22, "solitary")]
    rows = [(i, prose(rng, rng.randint(60, 200))) for i in range(120)]
    planted = set()
    for i in range(60):  # item 0, copied so often that each of its words is in far more than MAX_DF of the blocks
        rows[i] = (i, f"{rows[i][1]} {bench[0][1]} {prose(rng, 5)}")
        planted.add((i, 0))
    for i in range(60, 120):
        b = bench[12 + i % 3]
        at = rows[i][1].index(" ", len(rows[i][1]) // 2)
        rows[i] = (i, f"{rows[i][1][:at]} {b[1]}{rows[i][1][at:]}")
        planted.add((i, b[0]))
    table = spark.createDataFrame(bench, "item_id long, text string")
    items = decontam.read_items(table)[0]
    held = staged(decontam.benchmark_words(packed(frame(spark, rows)), items.vocab), "words")
    model = decontam.fit(held, items, np.arange(len(items.vocab), dtype=np.int32))
    assert not model.items[0].any(), "all words of item 0 are without weight"
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), table).collect()}
    assert planted <= found, sorted(planted - found)


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a, b = [[rng.randint(0, 5) for _ in range(rng.randint(1, 14))] for _ in "ab"]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        n, mask = decontam.common(np.asarray(a), np.asarray(b))
        assert n == table[-1][-1] == mask.sum()
        rest = iter(b)
        assert all(x in rest for x in np.asarray(a)[mask].tolist())


def slow_align(template, text):
    """The best local alignment without a band: its score."""
    best, score = 0, [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            same = template[i - 1] == text[j - 1]
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if same else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_alignment_in_a_band_that_holds_all():
    rng = random.Random(6)
    for _ in range(40):
        template = [rng.randint(0, 30) for _ in range(rng.randint(3, 25))]
        text = [w for t in template for w in ([t] if rng.random() < 0.8 else [rng.randint(0, 30)] if rng.random() < 0.5 else [])]
        text = [rng.randint(31, 60) for _ in range(rng.randint(0, 6))] + text + [rng.randint(31, 60) for _ in range(rng.randint(0, 6))]
        n, a, b = licenses.align(np.asarray(template, dtype=np.uint64), np.asarray(text, dtype=np.uint64), -len(template), len(text))
        common, _ = decontam.common(np.asarray(template), np.asarray(text))
        assert n <= common and 2 * n >= slow_align(template, text)
        assert n == 0 or (0 <= a < b <= len(text) and text[a] in template and text[b - 1] in template)


def test_licenses(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for i, (name, (text, needs, _)) in enumerate(licenses.TEMPLATES.items()):
        body = text.split()
        changed = " ".join(w for k, w in enumerate(body) if k % 12 != 7 or any(x in w.lower() for x in needs)) if len(body) > 20 else text
        rows += [(3 * i, f"{prose(rng, 50)} {text} {prose(rng, 50)}"), (3 * i + 1, f"{prose(rng, 30)}\n{changed.upper()}\n"), (3 * i + 2, prose(rng, 200))]
        want |= {(3 * i, name), (3 * i + 1, name)}
    rows += [(1000 + k, t) for k, t in enumerate(EDGES)] + [(0, rows[0][1]), (None, rows[0][1]), (2000, prose(rng, 20000) + " Released under the MIT License " + prose(rng, 10) + " Released under the MIT License")]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found and not {i for i, _ in found if i is not None and i < 1000 and i % 3 == 2} and sum(r.doc_id == 2000 for r in got) == 2
    assert sum(r.doc_id == 0 and r.license == list(licenses.TEMPLATES)[0] for r in got) == 2, "repeated rows come out alike"
    exact = next(r for r in got if r.doc_id == 0 and r.license == list(licenses.TEMPLATES)[0])
    assert exact.coverage == 1.0 and exact.matched_text == licenses.TEMPLATES[exact.license].text.lower() and exact.start_word == len(words([rows[0][1].split(" Licensed")[0]]).hash)
    # An independent slow aligner, without index, seeds or band: what it finds whole is found, or lies under a find of more words.
    index = licenses.build_index(licenses.TEMPLATES)
    for i, text in [r for r in rows if r[0] is not None and r[0] < 3 * len(licenses.TEMPLATES) and r[0] % 3 < 2][::4]:
        h = words([text]).hash.tolist()
        for t, name in enumerate(index.names):
            template = index.templates[t].tolist()
            if len(h) * len(template) < 6000 and slow_align(template, h) == 2 * len(template):
                needs, bars = index.needs[t], index.bars[t]
                best = [x for x in licenses.find(np.asarray(h, dtype=np.uint64), index) if x.coverage * len(index.templates[x.template]) > len(template)]
                assert (i, name) in found or best or not np.isin(needs, h).all() or np.isin(bars, h).any(), (i, name)
    assert licenses.scan_licenses(frame(spark, [])).isEmpty() and licenses.scan_licenses(frame(spark, rows), {"short": "two words"}).isEmpty()


def test_licenses_back_to_back():
    index = licenses.build_index(licenses.TEMPLATES)
    for name, (text, _, _) in licenses.TEMPLATES.items():
        size = len(words([text]).hash)
        for gap in ([], ["pkg"], ["another", "package"], [f"w{k}" for k in range(7)]):
            for copies in (2, 3, 40 if size < 20 else 7):
                found = licenses.find(words([" ".join([*gap, text] * copies)]).hash, index)
                spans = [(x.start, x.end) for x in found if index.names[x.template] == name and x.coverage == 1.0]
                assert spans == [(len(gap) + k * (len(gap) + size), (k + 1) * (len(gap) + size)) for k in range(copies)], (name, len(gap), copies)
    whole = licenses.TEMPLATES["GPL-3.0-notice"].text.split()
    cut = licenses.find(words([" ".join([*whole[:-2], *whole, *whole[2:]])]).hash, index)
    assert [(x.start, x.end) for x in cut if index.names[x.template] == "GPL-3.0-notice"] == [(10, 22), (22, 32)], "cut copies beside a whole one; the first lacks its version"


def test_licenses_of_one_family():
    """Variants are told apart, by words that they must or mustn't hold."""
    index = licenses.build_index(licenses.TEMPLATES)
    told = {
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": {"LGPL-3.0-header"},
        "This work is licensed under the GNU General Public License, version 2": {"GPL-2.0-notice"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"MPL-2.0-header"} & set(),
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": {"CC-BY-NC-ND-4.0"},
        "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0-notice"},
        licenses.TEMPLATES["BSD-2-Clause"].text: {"BSD-2-Clause"},
        licenses.TEMPLATES["Apache-2.0-header"].text: {"Apache-2.0-header"},
    }
    for text, names in told.items():
        assert {index.names[x.template] for x in licenses.find(words([text]).hash, index)} == names, text


def test_winnowing_keeps_one_of_each_window():
    g = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = licenses.winnow(g, 4).tolist()
    for a in range(197):
        part = g[a : a + 4]
        assert a + max(k for k in range(4) if part[k] == part.min()) in kept


def test_items_of_any_type_and_repeated_words(spark):
    """String ids; an item of one word 600 times; both found whole, and a very long text around one."""
    rng = random.Random(4)
    item = prose(rng, 40)
    bench = spark.createDataFrame([("q-1", item), ("q-2", " ".join(["again"] * 600)), ("q-1", "a second text of the same id, of eleven words in all")], "item_id string, text string")
    rows = [(1, prose(rng, 200) + " " + item), (2, " ".join(["again"] * 640)), (3, prose(rng, 300)), (4, prose(rng, 200_000) + item + prose(rng, 50))]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, "q-1"), (2, "q-2"), (4, "q-1")}


def test_very_long_texts_are_near_duplicates_too(spark):
    rng = random.Random(6)
    text = prose(rng, 250_000, 60_000)
    assert len(text) > 1_000_000
    got = rows_of(simhash.near_duplicates(frame(spark, [(1, text), (2, text + " one more"), (3, prose(rng, 3000, 60_000))])))
    assert got == [(2, 1, 2, 1)] or got == [(2, 1, 2, 0)]
