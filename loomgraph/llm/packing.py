"""Sum-of-squares online packing of documents into training windows.

A window holds ``window`` tokens. Let N(h) be the number of open windows filled to level h. A piece of s tokens goes
where the sum of N(h)^2 over the partial levels is least afterwards: into a window of some level h with
N(h) > 0 and h + s <= window, or into a new one. Ties go to the fullest level. Documents come online, in order of id,
and never move later. A document longer than a window fills whole windows first; its rest is
packed like any piece.

Packing is sequential, so documents are spread over independent packers by a hash of their id and text, one packer for about
``PACKER_TOKENS`` tokens at any size of the input; only ids and lengths are shuffled. Copies of one row are counted before that and
spread in lots of ``COPIES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import arrow_pass
from loomgraph.llm._tokens import DEFAULT_VOCAB, encoder
from loomgraph.operators.tables import staged

#: Tokens of a training window.
WINDOW = 2048
#: Tokens that one sequential packer takes on average.
PACKER_TOKENS = 20_000_000
#: Rows equal in id and text that go to one packer together.
COPIES = 4096


class Packer:
    """Level array and open windows of one sequential packer."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, first position) of a piece of 1 to ``window`` tokens."""
        b, n = self.window, self.level
        if size == b:
            self.windows += 1
            return self.windows - 1, 0
        # Growth of the sum of squares for each level h = 1 .. b - size, the level b counting as nothing.
        after = n[1 + size : b + 1]
        cost = 2 * (after - n[1 : b - size + 1]) + 2
        cost[-1] = 1 - 2 * n[b - size]
        cost[n[1 : b - size + 1] == 0] = np.iinfo(np.int64).max
        new = 2 * n[size] + 1
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if cost[best] <= new:
            level = best + 1
            window = self.open[level].pop()
            n[level] -= 1
        else:
            level, window = 0, self.windows
            self.windows += 1
        if level + size < b:
            n[level + size] += 1
            self.open[level + size].append(window)
        return window, level


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, piece, window, first position, tokens) for documents of the given lengths, in their order."""
    packer, out = Packer(window), []
    for doc, length in enumerate(lengths):
        for piece, start in enumerate(range(0, int(length), window)):
            size = min(window, int(length) - start)
            out.append((doc, piece, *packer.place(size), size))
    return out


def count_tokens(docs: DataFrame, vocab: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k, n): tokens of each document with the one that ends it."""
    id_type = dict(docs.dtypes)[id_col]

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        n = [len(enc.ids(t)) + 1 if t else 0 for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["_id", "_k", "n"])

    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_k"), F.col(f"`{text_col}`").alias("_text"))
    return arrow_pass(source, count, f"_id {id_type}, _k long, n long")


def pack_documents(
    docs: DataFrame, window: int = WINDOW, packer_tokens: int = PACKER_TOKENS, vocab: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, packer, window, position, n_tokens): where each piece of each document lies.

    Lengths are token counts of the vocabulary, plus one for the token that ends a document. Null and empty texts have
    no piece and no row. Rows with equal id and text are packed as often as they occur; they are alike,
    so their order doesn't matter. Rows with one id and several texts are documents of their own, ordered by a hash of the text; rows
    with a null id come first. A text of any length is cut into whole windows and a rest. Other columns aren't
    read, so their names can't clash. An empty table gives an empty result.
    """
    id_type = dict(docs.dtypes)[id_col]
    lengths = staged(count_tokens(docs, vocab, id_col, text_col).filter("n > 0").groupBy("_id", "_k", "n").agg(F.count(F.lit(1)).alias("_m")), "lengths")
    total = lengths.agg(F.sum(F.col("n") * F.col("_m"))).first()[0] or 0
    packers = max(1, -(-total // packer_tokens))
    lots = lengths.withColumn("_lot", F.explode(F.sequence(F.lit(0), ((F.col("_m") - 1) / COPIES).cast("int")))).withColumn("_m", F.least(F.lit(COPIES), F.col("_m") - F.col("_lot").cast("long") * COPIES))
    spread = lots.withColumn("packer", F.pmod(F.xxhash64("_k", "_lot"), F.lit(packers)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        order = np.asarray(pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("_k", "ascending")], null_placement="at_start"))
        table = table.take(pa.array(np.repeat(order, np.asarray(table["_m"])[order])))
        rows = np.asarray(pack_lengths(table["n"].to_pylist(), window), dtype=np.int64).reshape(-1, 5)
        of, piece, at, position, n = rows.T
        packer = np.full(len(rows), table["packer"][0].as_py())
        return pa.table([table["_id"].take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(packer, pa.int32()), pa.array(at), pa.array(position, pa.int32()), pa.array(n, pa.int32())], names=[id_col, "piece", "packer", "window", "position", "n_tokens"])

    return spread.groupBy("packer").applyInArrow(pack, f"`{id_col}` {id_type}, piece int, packer int, window long, position int, n_tokens int")
