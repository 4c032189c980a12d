"""Row identity and Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that one step of a NumPy pass works on.
PIECE_CHARS = 1_000_000


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (_row, _id, _k, _text): the whole row as a struct, so that no column of it can clash with ours.

    ``_k`` hashes id and text. Rows that agree in both are copies of one document and share a key.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_k"),
        F.col(f"`{text_col}`").alias("_text"),
    )


def unpacked(work: DataFrame, columns: list[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``_row`` under their names, some of them replaced."""
    replaced = replaced or {}
    return work.select(*[replaced[c].alias(c) if c in replaced else F.col("_row").getField(c).alias(c) for c in columns])


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` over pieces of bounded text, whatever the size of the batches that Spark sends.

    ``fn`` gets batches whose last column is the text; a text longer than the bound is a batch of its own.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield from (out for piece in pieces(batch) for out in fn(piece))

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes in the last column."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
