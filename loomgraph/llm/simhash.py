"""SimHash near-duplicates by pivot distance tables.

Fingerprints have 256 bits: bit by bit the majority over a document's distinct words, each word with one vote. They need nothing from the
corpus, so they are the same in every run. Two documents are near-duplicates if their fingerprints differ in at most ``RADIUS`` bits, which
is where texts share about three quarters of their words; unrelated texts differ in 90 bits and more.

Distances from whole fingerprints to whole references hardly differ between random texts (128 bits, give or take 8), so no table of them discards anything at
this radius. The reference fingerprints are therefore short: ``BLOCKS`` blocks of bits have ``PIVOTS`` references each, and the
table holds the Hamming distance of every block to each of its references. In a block, two documents differ by at least their largest
difference over its coordinates; the sum over the blocks is a lower bound of the distance. A pair whose bound is above the radius is
discarded, which takes nearly all unrelated pairs; survivors are verified on the full fingerprints.

Comparing all pairs through the table would still grow with the square of the corpus, so fingerprints are cut into blocks of about as many
bits as the corpus has doublings. A pair within ``RADIUS`` differs in few bits in at least one of them (``blocks_plan``), so looking up every value that is so few
flips away finds all pairs, whatever the data. Documents with one fingerprint are one item of the search, whatever their number. Each pair is found
in one place and counted and joined up there at once, not emitted. The work still grows faster than the corpus: a fixed share of all pairs, less with wider blocks, agrees in
some block and is compared there.

``key_plan`` to ``compared`` are the search by sampled keys of earlier rounds, which misses some pairs; only their tests call them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import arrow_pass, packed, unpacked
from loomgraph.llm._text import doc_bounds, mix64, words
from loomgraph.operators.tables import staged

BITS = 256
#: Most bits in which near-duplicates differ.
RADIUS = 48
#: Blocks of a fingerprint, and reference fingerprints for each.
BLOCKS, PIVOTS = 16, 4
#: Of sampled keys: probability with which a pair that differs in ``CLOSE`` bits must meet in some table.
RECALL, CLOSE = 0.97, 36
#: The same for a pair that differs in ``RADIUS`` bits, the most that counts.
FAR_RECALL = 0.9
#: Fingerprints that may share a bucket by chance, on average; the keys' width follows from it and the corpus.
BUCKET = 48
#: Fingerprints of a group; a task compares two groups.
CHUNK = 1 << 19
#: Tasks that a small corpus is searched in at least (one block each at most), and partitions that a large one has at most.
TASKS, PARTITIONS = 64, 4096
#: Pairs that are worked on at once.
LOT = 1 << 17
_LANES = BITS // 64
_SEED = 20240229
_EACH = np.uint64(0x0101010101010101)


def doc_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, word hash) of the distinct words of each text, sorted."""
    w = words(texts)
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def fingerprints(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of ``n`` documents as (n, lanes) unsigned numbers; 0 for a document without words.

    Votes are counted in the bytes of 64-bit sums, every eighth bit at once, over stretches of at most 255 words.
    """
    out = np.zeros((n, _LANES), dtype=np.uint64)
    bounds = doc_bounds(doc, n)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    size = np.diff(bounds)[full]
    stretches = -(-size // 255)
    of = np.cumsum(stretches) - stretches
    start = np.repeat(bounds[full], stretches) + (np.arange(stretches.sum()) - np.repeat(of, stretches)) * 255
    votes = np.empty((len(start), 8, 8), dtype=np.int32)
    for lane in range(_LANES):
        mixed = mix64(h + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for k in range(8):
            votes[:, :, 7 - k] = np.add.reduceat(mixed >> np.uint64(k) & _EACH, start).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(votes, of, axis=0) if len(start) > len(full) else votes
        out[full, lane] = np.packbits(2 * total > size[:, None, None]).view(np.uint64)
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of an array of unsigned numbers."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def pivots() -> np.ndarray:
    """(blocks, pivots) reference fingerprints of one block each: fixed and random."""
    return np.random.default_rng(_SEED).integers(0, 1 << BITS // BLOCKS, size=(BLOCKS, PIVOTS), dtype=np.uint16)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """(pivots, n, blocks) Hamming distances of each block of each fingerprint to its references."""
    blocks = np.ascontiguousarray(fp).view(np.uint16).reshape(len(fp), BLOCKS)
    return np.stack([np.bitwise_count(blocks ^ refs) for refs in pivots().T])


def possible(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs of rows of the pivot table may be within ``radius``: the largest differences of the blocks, summed, bound the distance from below."""
    most = np.zeros((len(i), BLOCKS), dtype=np.uint8)
    for one in table:
        a, b = one[i], one[j]
        np.maximum(most, np.maximum(a, b) - np.minimum(a, b), out=most)
    halves = most.view(np.uint64)
    return (halves[:, 0] + halves[:, 1]) * _EACH >> np.uint64(56) <= radius  # the sum of all bytes; 256, for opposites, comes out as 0 and is verified


def key_plan(items: int) -> tuple[int, np.ndarray]:
    """(bits of a key, bit positions of each table) for a corpus of ``items`` fingerprints.

    The key grows with the logarithm of the corpus, so that buckets don't, and the number of tables is what gives
    ``RECALL`` for pairs at distance ``CLOSE`` and ``FAR_RECALL`` for pairs at ``RADIUS``.
    """
    width = int(np.clip(np.ceil(np.log2(max(items, 2) / BUCKET)), 8, 40))
    at = np.arange(width)
    meet = {bits: np.prod((BITS - bits - at) / (BITS - at)) for bits in (CLOSE, RADIUS)}  # a table's bits are distinct
    tables = max(int(np.ceil(np.log(1 - recall) / np.log(1 - meet[bits]))) for recall, bits in ((RECALL, CLOSE), (FAR_RECALL, RADIUS)))
    rng = np.random.default_rng(_SEED + 1)
    return width, np.stack([rng.choice(BITS, size=width, replace=False) for _ in range(tables)])


def pairs_at(lag: int, active: np.ndarray, key: np.ndarray, table: np.ndarray, fp: np.ndarray, radius: int, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that still have a row of their key ``lag`` further on, those of them that are within ``radius`` of it); see ``compared`` for ``right``."""
    active = active[active + lag < len(key)]
    active = active[key[active] == key[active + lag]]
    near = []
    for at in range(0, len(active), 1 << 15):
        i = active[at : at + (1 << 15)]
        if right is not None:
            i = i[right[i] != right[i + lag]]
        i = i[possible(table, i, i + lag, radius)]
        near.append(i[popcount(fp[i] ^ fp[i + lag]) <= radius])
    return active, np.concatenate(near) if near else active[:0]


def first_meeting(x: np.ndarray, y: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """True where no earlier table has equal keys for the pair: each pair is counted by one table alone."""
    out, differ = np.ones(len(x), dtype=bool), x ^ y
    for t in range(int(table.max(initial=0))):
        rows = np.flatnonzero(out & (table > t))
        out[rows[~(differ[rows] & masks[t]).any(axis=1)]] = False
    return out


def key_masks(positions: np.ndarray) -> np.ndarray:
    """(tables, lanes) the bits of each table's key as masks of a fingerprint."""
    bits = np.zeros((len(positions), BITS), dtype=np.uint8)
    np.put_along_axis(bits, positions, 1, axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


class Linked:
    """Links among some fingerprints: how many each has, and which are joined up by them."""

    def __init__(self, n: int) -> None:
        self.links, self.root = np.zeros(n, dtype=np.int64), np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray, new: np.ndarray) -> None:
        """Join i and j; those that are ``new`` count."""
        np.add.at(self.links, i[new], 1)
        np.add.at(self.links, j[new], 1)
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]

    def rows(self, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row (a, b, links) for each that has links: b with the root a that it is joined to, itself perhaps."""
        some = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(fp))))
        for s in range(0, len(some), 10_000):
            at = some[s : s + 10_000]
            cols = [pa.array([x.tobytes() for x in fp[k]], pa.binary()) for k in (self.root[at], at)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(self.links[at])], ["a", "b", "links"])


def compared(key: np.ndarray, fp: np.ndarray, masks: np.ndarray, radius: int, right: np.ndarray | None = None) -> Linked:
    """Links among the rows of equal keys, ``key`` being sorted; with ``right`` only between rows of which one has it and one hasn't."""
    table, out, lag, active = pivot_table(fp), Linked(len(fp)), 1, np.arange(len(fp) - 1)
    while len(active):
        active, i = pairs_at(lag, active, key, table, fp, radius, right)
        if len(i):
            out.add(i, i + lag, first_meeting(fp[i], fp[i + lag], key[i] >> 44, masks))
        lag += 1
    return out


def fingerprint_docs(docs: DataFrame) -> DataFrame:
    """(_id, _k, _fp) of every document with a word; ``docs`` as ``packed`` gives it."""
    id_type = dict(docs.dtypes)["_id"]

    def compute(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, h = doc_words(batch.column(2).to_pylist())
        fp = fingerprints(doc, h, batch.num_rows)
        has = np.diff(doc_bounds(doc, batch.num_rows)) > 0
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in fp], pa.binary())], ["_id", "_k", "_fp"])
        yield out.filter(pa.array(has))

    return arrow_pass(docs.select("_id", "_k", "_text"), compute, f"_id {id_type}, _k long, _fp binary")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, _LANES)


def blocks_plan(items: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, end, most) of the blocks of a fingerprint: of a pair within ``radius``, at least one block differs in at most ``most`` bits.

    Otherwise it would differ in at least the sum of ``most + 1``, which is ``radius + 1``. A block has about as many bits as
    there are doublings in ``items``, so that a value of it has few of them.
    """
    n = BITS // int(np.clip(np.ceil(np.log2(max(items, 2))), 8, 24))
    ends = [BITS * k // n for k in range(n + 1)]
    most, wider = divmod(radius + 1, n)
    plan = [(s, e, most if k < wider else most - 1) for k, (s, e) in enumerate(zip(ends, ends[1:]))]
    return [(s, e, m) for s, e, m in plan if m >= 0]


def block_masks(plan: list[tuple[int, int, int]]) -> np.ndarray:
    """(blocks, lanes) the bits of each block as masks of a fingerprint."""
    bits = np.zeros((len(plan), BITS), dtype=np.uint8)
    for k, (s, e, _) in enumerate(plan):
        bits[k, s:e] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def block_values(fp: np.ndarray, start: int, end: int) -> np.ndarray:
    """Bits ``start`` to ``end`` of each fingerprint as a number."""
    out = np.zeros(len(fp), dtype=np.int32)
    for byte in np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1)[:, start // 8 : -(-end // 8)].T:
        out = out << 8 | byte
    return out >> -end % 8 & (1 << end - start) - 1


def candidates(value: np.ndarray, bounds: np.ndarray, flip: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), in lots of about ``LOT``, of sorted values and places of the values that differ from them in the bits of ``flip``.

    ``bounds`` has where each value begins. If the places are those of ``value`` itself (``own``), each pair comes once.
    """
    rows = np.arange(len(value))
    if own and flip:
        rows = np.flatnonzero((value & 1 << flip.bit_length() - 1) == 0)  # the other one of the pair has this bit
    to = value[rows] ^ flip
    first, end = bounds[to], bounds[to + 1]
    if own and not flip:
        first = rows + 1
    size = end - first
    some = np.flatnonzero(size)
    rows, first, size = rows[some], first[some], size[some]
    total = np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(LOT, total[-1] + LOT, LOT)) + 1 if len(total) else []
    for s, e in zip([0, *cuts], cuts):
        n = size[s:e]
        if len(n):
            yield np.repeat(rows[s:e], n), np.arange(n.sum()) + np.repeat(first[s:e] - np.cumsum(n) + n, n)


def near_pairs(a: np.ndarray, b: np.ndarray | None, plan: list[tuple[int, int, int]], block: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of all pairs within ``radius`` of which ``block`` is the first block of the plan that differs little enough; without b, pairs in a.

    Rows are sorted by the value of the block, and each flip of at most ``most`` bits leads from a value to another one. A pair is compared on the half of its bits that the
    block isn't in; what is left goes through the pivot table and then whole.
    """
    start, end, most = plan[block]
    own, masks = b is None, block_masks(plan)
    half, apart = 2 if end <= BITS // 2 else 0, end <= BITS // 2 or start >= BITS // 2

    def by_value(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = block_values(fp, start, end)
        order = np.argsort(value, kind="stable")
        return order, value[order], fp[order]

    order_a, value, fa = by_value(a)
    order_b, there, fb = (order_a, value, fa) if own else by_value(b)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(there, minlength=1 << end - start))])
    table, shift = (pivot_table(fa), 0) if own else (pivot_table(np.concatenate([fa, fb])), len(fa))
    lanes = [(np.ascontiguousarray(fa[:, k]), np.ascontiguousarray(fb[:, k])) for k in (half, half + 1)]

    def checked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = possible(table, i, j + shift, radius)
        i, j = i[keep], j[keep]
        differ = fa[i] ^ fb[j]
        keep = popcount(differ) <= radius
        for k in range(block):
            keep &= popcount(differ & masks[k]) > plan[k][2]
        return order_a[i[keep]], order_b[j[keep]]

    flips = np.arange(1 << end - start)
    held, rows = [], 0
    for flip in flips[np.bitwise_count(flips) <= most].tolist():
        least = radius - (flip.bit_count() if apart else 0)
        for i, j in candidates(value, bounds, flip, own):
            (a0, b0), (a1, b1) = lanes
            keep = np.bitwise_count(a0[i] ^ b0[j]) + np.bitwise_count(a1[i] ^ b1[j]) <= least
            held.append((i[keep], j[keep]))
            rows += len(held[-1][0])
            if rows > LOT:
                yield checked(*map(np.concatenate, zip(*held)))
                held, rows = [], 0
    if rows:
        yield checked(*map(np.concatenate, zip(*held)))


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b, links): how the distinct fingerprints in column ``_fp`` that differ in at most ``radius`` bits hang together.

    ``links`` summed over the rows of a fingerprint b is the number of others that it is near to, all of them. Rows with a < b or b < a join
    the two up: the components of these rows are those of all near pairs. Fingerprints are dealt to groups of about ``chunk``, and each two groups meet in a task, or
    in one for each of several lots of blocks where groups are few.
    """
    items = distinct.count()
    plan = blocks_plan(min(items, chunk), radius)
    groups = max(1, -(-items // chunk))
    meetings = groups * (groups + 1) // 2
    lots = int(np.clip(-(-TASKS // meetings), 1, len(plan)))

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            one, two, lot = at
            fp, second = np.concatenate([f for f, _ in held]), np.concatenate([s for _, s in held])
            order = np.argsort(second, kind="stable")
            fp, n = fp[order], len(fp) - int(second.sum())
            linked, pairs, rows = Linked(len(fp)), [], 0

            def join() -> None:
                i, j = map(np.concatenate, zip(*pairs))
                linked.add(i, j, np.ones(len(i), dtype=bool))

            for block in range(lot, len(plan), lots):
                for i, j in near_pairs(fp[:n], fp[n:] if one != two else None, plan, block, radius):
                    pairs.append((i, j if one == two else j + n))
                    rows += len(i)
                    if rows > LOT:
                        join()
                        pairs, rows = [], 0
            if rows:
                join()
            yield from linked.rows(fp)

        for batch in source:
            place = np.stack([np.asarray(batch.column(c)) for c in (1, 2, 3)], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    of = tuple(place[s].tolist())
                    if at is not None and of != at:
                        yield from done()
                        held = []
                    at = of
                    held.append((_prints(batch.column(0).slice(s, e - s)), (np.asarray(batch.column(4))[s:e] == of[1]) & (of[0] != of[1])))
        if at is not None:
            yield from done()

    grouped = distinct.select("_fp", F.pmod(F.xxhash64("_fp"), F.lit(groups)).cast("int").alias("_group"))
    met = grouped.select("_fp", "_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_other"))
    place = ["_one", "_two", "_lot"]
    tasks = met.select("_fp", F.least("_group", "_other").alias("_one"), F.greatest("_group", "_other").alias("_two"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot"), "_group")
    number = (F.col("_two") * (F.col("_two") + 1) / 2 + F.col("_one")) * lots + F.col("_lot")  # without gaps, so that no two tasks share one while there are enough
    many = min(meetings * lots, PARTITIONS)
    return tasks.repartitionById(many, F.pmod(number.cast("long"), F.lit(many)).cast("int")).sortWithinPartitions(*place).mapInArrow(compare, "a binary, b binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b): the root is a component's least node.

    Alternates large-star and small-star steps, each a grouping and a join, written out in between; the number
    of rounds grows with the logarithm of a component's size. It ends when a round leaves the links as they were, by their number
    and the sum of their hashes.
    """

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())

    links = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        linked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        new = staged(linked, "links")
        after = mark(new)
        if after == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links, before = new, after


def duplicate_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(_id, _k, _kid, _kk, _copies, _size, _links): each document with words, the one its group keeps, rows alike, documents in the group, near fingerprints.

    ``docs`` is as ``packed`` gives it. A group is a connected component of near-duplicates.
    """
    prints = staged(fingerprint_docs(docs).groupBy("_id", "_k", "_fp").agg(F.count(F.lit(1)).alias("_copies")), "fingerprints")
    links = staged(near_fingerprints(prints.select("_fp").distinct(), radius), "near")
    near = links.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("_links"))
    roots = near.join(components(links.select("a", "b")), "node", "left")
    labelled = prints.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("_group", F.coalesce("root", "_fp")).withColumn("_links", F.coalesce("_links", F.lit(0)))
    kept = labelled.groupBy("_group").agg(F.min(F.struct("_id", "_k")).alias("_keep"), F.sum("_copies").alias("_size")).filter("_size > 1")
    return labelled.join(kept, "_group").select("_id", "_k", F.col("_keep._id").alias("_kid"), F.col("_keep._k").alias("_kk"), "_copies", "_size", "_links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, duplicate_of, group_size, links): a row for each document that repeats another one, with the document its group keeps.

    A group keeps its least id (null before others; for equal ids the least hash of the text); every other
    document of it has a row. ``links`` counts the other fingerprints that its own is near to; documents that share one count once. Rows
    equal in id and text are copies: all but one of them are repeats of themselves. Null and
    empty texts, and texts without a letter or digit, belong to no group. Long texts count whole. Other columns aren't read, so their
    names can't clash. An empty table gives an empty result.
    """
    groups = duplicate_groups(packed(docs, id_col, text_col), radius)
    keeper = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_k") == F.col("_kk"))
    times = F.col("_copies") - F.when(keeper, 1).otherwise(0)
    repeats = groups.filter(times > 0).select(F.explode(F.array_repeat(F.lit(1), times.cast("int"))), "_id", "_kid", "_size", "_links")
    return repeats.select(F.col("_id").alias(id_col), F.col("_kid").alias("duplicate_of"), F.col("_size").alias("group_size"), F.col("_links").alias("links"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; see ``near_duplicates`` for the groups.

    Documents without words all stay. Of rows equal in id and text one stays, that with the least hash of its columns.
    Other columns come along under their names, whatever these are.
    """
    from pyspark.sql import Window

    work = packed(docs, id_col, text_col)
    keeper = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_k") == F.col("_kk"))
    groups = duplicate_groups(work, radius).select(F.col("_id").alias("_id2"), F.col("_k").alias("_k2"), F.when(keeper, F.col("_copies")).otherwise(0).alias("_stay"))
    joined = work.select("_row", "_id", "_k").join(groups, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_k") == F.col("_k2")), "left")
    # Few rows have copies of themselves; only they are shuffled again.
    once = joined.filter(F.coalesce("_stay", F.lit(1)) == 1)
    first = F.row_number().over(Window.partitionBy("_id", "_k").orderBy(F.xxhash64("_row")))
    many = joined.filter("_stay > 1").withColumn("_n", first).filter("_n = 1")
    return unpacked(once.select("_row").unionByName(many.select("_row")), docs.columns)
