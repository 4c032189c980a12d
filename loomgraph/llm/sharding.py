"""Consistent placement of documents on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: offset + j * skip, both
from a hash of its name. Shards take turns; each claims the first slot of its order that is
still free, until all are taken. A key hashes to a slot, so placement is one array look-up. Slots
per shard differ by one at most, and a shard that leaves moves hardly any key of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production table: 64 shards and a prime over 100 slots for each.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
TABLE_SIZE = 6553
#: Tables up to this many slots travel in the plan as one array; larger ones are joined by slot.
ARRAY_SLOTS = 100_000


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's preference order."""
    return _number(f"{shard}/offset") % size, _number(f"{shard}/skip") % (size - 1) + 1


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The index of the shard in each slot.

    ``size`` must be prime and at least the number of shards; shard names must differ.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime that isn't below the number of shards")
    orders = [preference(s, size) for s in shards]
    at, table, free = [0] * len(shards), np.full(size, -1, dtype=np.int32), size
    while free:
        for i, (offset, skip) in enumerate(orders):
            slot = (offset + at[i] * skip) % size
            while table[slot] >= 0:
                at[i] += 1
                slot = (offset + at[i] * skip) % size
            table[slot], free = i, free - 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text modulo the table's size. A null key has the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long") % F.lit(size)


def assign_shards(docs: DataFrame, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """(key, slot, shard) for each row of ``docs``.

    Rows with equal keys go to one shard, null keys together to the shard of the text 'null'; every input row gives
    one row, repeated ones included. Other columns are not looked at and don't come along, so their names
    can't clash. An empty table gives an empty one. No shuffle for a table that fits in
    the plan (``ARRAY_SLOTS``); beyond it the table is joined by slot, and Spark picks the join by its size.
    """
    table = lookup_table(shards, size)
    keyed = docs.select(F.col(f"`{key}`").alias(key), slot_of(F.col(f"`{key}`"), size).alias("slot"))
    if size <= ARRAY_SLOTS:
        index = F.from_json(F.lit("[" + ",".join(map(str, table.tolist())) + "]"), "array<int>")
        names = F.from_json(F.lit("[" + ",".join('"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in shards) + "]"), "array<string>")
        return keyed.select(key, "slot", F.get(names, F.get(index, F.col("slot").cast("int"))).alias("shard"))
    import pandas as pd

    slots = docs.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(size), "shard": np.asarray(shards, dtype=object)[table]}))
    return keyed.join(slots, "slot").select(key, "slot", "shard")
