"""Global removal of repeated runs of units (lines or sentences), shared by the two exact deduplicators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import packed, pieces, unpacked
from loomgraph.llm._text import mix64, span_hash

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Units(NamedTuple):
    """Units of a batch of texts in order: text number, bytes [start, end) of ``data`` that are compared, offsets of each text's units."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


class Runs(NamedTuple):
    """Runs that count: units [first, end) of a batch."""

    first: np.ndarray
    end: np.ndarray


def gathered(parts: list[bytes], cuts: list[list[int]]) -> Units:
    """Units of texts that are cut at the given byte offsets."""
    size = np.asarray([len(p) for p in parts], dtype=np.int64)
    at = np.cumsum(size) - size
    count = np.asarray([len(c) + 1 for c in cuts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(count)))
    inner = np.fromiter((x for c in cuts for x in c), dtype=np.int64, count=int(count.sum() - len(count))) + np.repeat(at, count - 1)
    first, last = np.zeros(bounds[-1], dtype=bool), np.zeros(bounds[-1], dtype=bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    start, end = np.empty(bounds[-1], dtype=np.int64), np.empty(bounds[-1], dtype=np.int64)
    start[first], start[~first] = at, inner
    end[last], end[~last] = at + size, inner
    return Units(np.frombuffer(b"".join(parts), dtype=np.uint8), start, end, bounds)


def run_hashes(u: Units, r: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and of 32 bits of each run: polynomials in the hashes of its units, which depend on the units' bytes and their order alone."""
    out, n = [], len(u.start)
    h = span_hash(u.data, u.start, u.end)
    for base in _BASES:
        power = np.concatenate((np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))))
        inverse = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, pow(int(base), -1, 1 << 64), dtype=np.uint64))))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix64(h + base) * power[:n], dtype=np.uint64)))
        out.append(mix64((sums[r.end] - sums[r.first]) * inverse[r.first] + (r.end - r.first).astype(np.uint64)).view(np.int64))
    return out[0], (out[1] >> 32).astype(np.int32)


_RUN = ["_id", "_k", "_pos", "_len"]


class Seen:
    """Sifts the runs of one task: those that surely aren't the first of their hash, by another one of the task, have no hash in what comes out; of the rest, the first of each hash is left.

    Hashes that a batch holds more than once are remembered for the batches that follow, up to ``most``; what is forgotten is sifted after the shuffle.
    """

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.first = most, {}

    def sifted(self, ids: pa.Array, k: pa.Array, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        key = np.asarray(k)
        order = np.asarray(pc.sort_indices(pa.table([ids, k], names=["_id", "_k"]), sort_keys=[("_id", "ascending"), ("_k", "ascending")], null_placement="at_start"))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], key[order][1:] != key[order][:-1])))  # equal keys: copies of one row
        by = np.lexsort((pos, rank[doc], h2, h1))
        doc, pos, size, h1, h2 = doc[by], pos[by], size[by], h1[by], h2[by]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        start = np.flatnonzero(new)
        head = start[np.cumsum(new) - 1]
        repeat = (rank[doc] != rank[doc[head]]) | (pos != pos[head])
        keep = new.copy()
        many = np.diff(np.append(start, len(new))) > 1
        hashes = h1[start].tolist()
        known = [g for g, h in enumerate(hashes) if h in self.first]
        for g in {*known, *np.flatnonzero(many).tolist()}:
            at, h = start[g], hashes[g]
            i = ids[int(doc[at])].as_py()
            mine, held = (i is not None, i, int(key[doc[at]]), int(pos[at])), self.first.get(h)
            if held is None or held[0] != h2[at]:
                self.first[h] = (h2[at], mine)
            elif mine == held[1]:
                keep[at] = False
            elif (mine[0], mine[1] or 0, *mine[2:]) > (held[1][0], held[1][1] or 0, *held[1][2:]) if mine[1] is None or held[1][1] is None else mine > held[1]:
                keep[at], repeat[at] = False, True
            else:
                self.first[h] = (h2[at], mine)
        if len(self.first) > self.most:
            self.first.clear()
        out = np.flatnonzero(keep | repeat)
        of, sure = pa.array(doc[out]), repeat[out]
        yield pa.RecordBatch.from_arrays([ids.take(of), k.take(of), pa.array(pos[out], pa.int32()), pa.array(size[out], pa.int32()), pa.array(h1[out], mask=sure), pa.array(h2[out], pa.int32(), mask=sure)], [*_RUN, "_h1", "_h2"])


def not_first(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by hash, id, key and position, those without a hash, and those that differ from the first of their hash."""
    last = None  # hash, key and position of the first run of the hash that may go on
    for batch in source:
        if not batch.num_rows:
            continue
        sure = np.asarray(batch.column(4).is_null())
        h1, h2, k, pos = (np.asarray(batch.column(c).fill_null(0)) for c in (4, 5, 1, 2))
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | sure[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        first_k, first_pos = k[head], pos[head]
        if last is not None and not sure[0] and (h1[0], h2[0]) == last[:2]:
            again = head == 0
            first_k, first_pos = np.where(again, last[2], first_k), np.where(again, last[3], first_pos)
        last = (h1[-1], h2[-1], first_k[-1], first_pos[-1]) if not sure[-1] else None
        yield pa.RecordBatch.from_arrays(batch.columns[:4], _RUN).filter(pa.array(sure | (k != first_k) | (pos != first_pos)))


def without_repeats(
    docs: DataFrame, units: Callable[[list[str]], Units], runs: Callable[[Units], Runs], split: Callable[[str], list[str]], glue: str, id_col: str, text_col: str, removed: str | None
) -> DataFrame:
    """``docs`` with the units covered by later occurrences of a run left out of the text.

    ``units`` cuts texts into what is compared, ``runs`` says which runs of units count. A run's
    first occurrence is the least (id, hash of the text, position), null ids before others; copies of one
    row share all three, so all keep it. ``split`` cuts a text into as many units and ``glue`` joins what is left.
    With a name in ``removed`` the result is (id, text, units removed) under that name; else the columns of ``docs``.

    Only hashes and positions are shuffled by hash, once, and sorted; the first of equal hashes stays and the rest is reported. Of equal hashes
    within one task only the first goes there (see ``Seen``), so a run with millions of occurrences is no large group.
    """
    work = packed(docs, id_col, text_col)
    id_type = dict(work.dtypes)["_id"]

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in source:
            for piece in pieces(batch):
                piece = piece.filter(piece.column(2).is_valid())
                u = units(piece.column(2).to_pylist())
                r = runs(u)
                doc = u.doc[r.first]
                yield from seen.sifted(piece.column(0), piece.column(1), doc, r.first - u.bounds[doc], r.end - r.first, *run_hashes(u, r))

    run = f"_id {id_type}, _k long, _pos int, _len int"
    found = work.select("_id", "_k", "_text").mapInArrow(find, f"{run}, _h1 long, _h2 int")
    met = found.repartition(F.coalesce("_h1", "_k")).sortWithinPartitions("_h1", "_h2", "_id", "_k", "_pos")
    later = met.mapInArrow(not_first, run)
    covered = later.groupBy("_id", "_k").agg(F.collect_set(F.col("_pos").cast("long") * F.lit(1 << 32) + F.col("_len")).alias("_at"))
    right = covered.select(F.col("_id").alias("_id2"), F.col("_k").alias("_k2"), "_at")
    joined = work.join(right, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_k") == F.col("_k2")), "left")

    @F.pandas_udf("text string, removed int")
    def cut(texts, spans):  # type: ignore[no-untyped-def]
        import pandas as pd

        out = [remove(t, s) for t, s in zip(texts, spans)]
        return pd.DataFrame(out, columns=["text", "removed"])

    def remove(text: str | None, spans: np.ndarray | None) -> tuple[str | None, int]:
        if text is None or spans is None:
            return None, 0
        parts, spans = split(text), np.asarray(spans, dtype=np.int64)
        edge = np.zeros(len(parts) + 1, dtype=np.int64)
        np.add.at(edge, spans >> 32, 1)
        np.add.at(edge, (spans >> 32) + (spans & 0xFFFFFFFF), -1)
        drop = np.cumsum(edge[:-1]) > 0
        return glue.join(u for u, d in zip(parts, drop) if not d), int(drop.sum())

    hit = F.col("_at").isNotNull()  # not deterministic, as a later filter on the text would have it cut a second time for that
    done = joined.withColumn("_cut", cut.asNondeterministic()(F.when(hit, F.col("_text")), F.col("_at")))
    text = F.when(hit, F.col("_cut.text")).otherwise(F.col("_text"))
    if removed is None:
        return unpacked(done, docs.columns, {text_col: text})
    return done.select(F.col("_id").alias(id_col), text.alias(text_col), F.when(hit, F.col("_cut.removed")).otherwise(F.lit(0)).alias(removed))
