"""Token-ID output in training order: a keyed Feistel permutation gives every sequence its slot in fixed-stride shards.

Documents are encoded, put in the order of a hash of id and text, and joined to one stream, each ended by the id that ends a document. Every
``LENGTH`` ids of the stream are a sequence; the last is filled up. A Feistel network over the least even number
of bits that holds the N sequences, walked until it falls below N, permutes their numbers: that is the training order, a bijection that needs no
table and no sort. Slot s lies in shard s // ``SHARD_SEQUENCES`` at byte (s % ``SHARD_SEQUENCES``) * stride, so a reader
finds any position by arithmetic and resumes anywhere.

Encoding is done once. Ids travel compressed, first to their range of the hash, into a table in the shared folder, then, when the length of the
stream is known, to their shard, which is put together in memory and written. Every work is done on whole pieces of many documents.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import pieces
from loomgraph.llm._tokens import DEFAULT_VOCAB, END_OF_TEXT, encoder
from loomgraph.operators.tables import shared_dir, staged

#: Ids of a sequence; a stride is twice as many bytes.
LENGTH = 1024
#: Sequences of a shard (16 MB).
SHARD_SEQUENCES = 8192
KEY = "training-order-0"
ROUNDS = 6
#: Partitions at most, of hashes and of shards; each may hold several shards. What the driver collects is a number for each.
MAX_PARTITIONS = 100_000
#: Copies of a row, in one task, that stay together.
COPIES = 16
#: Ids of documents that are compressed together.
BLOCK_IDS = 1 << 20
_PLACE = ["_id", "piece", "slot", "shard", "offset", "n_tokens"]


def open_folder(url: str):  # type: ignore[no-untyped-def]
    """(file system, path) of a folder by its address; an absolute path is one of the mounted file system. Raises where there is no such file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url.rstrip("/"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


class Order(NamedTuple):
    """A permutation of 0 .. n - 1."""

    n: int
    half: int
    keys: tuple[int, ...]


def order(n: int, key: str = KEY) -> Order:
    """The permutation of ``n`` numbers for a key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    digest = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    return Order(n, half, tuple(digest))


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, o: Order, back: bool = False) -> np.ndarray:
    """The slots of numbers, or with ``back`` the numbers of slots."""
    mask, half = np.uint64((1 << o.half) - 1), np.uint64(o.half)
    x = np.asarray(i, dtype=np.uint64).copy()
    walking = np.arange(len(x))
    while len(walking):
        left, right = x[walking] >> half, x[walking] & mask
        for k in reversed(o.keys) if back else o.keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        x[walking] = left << half | right
        walking = walking[x[walking] >= np.uint64(o.n)]
    return x.astype(np.int64)


def _blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_part, _id, _n, _ids) of one partition in order, gathered to rows (_part, _first, _id array, _n array, _ids) of many documents each."""
    import zstandard

    squeeze, expand = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
    held: list[tuple[pa.Array, np.ndarray, list[bytes]]] = []
    part, first, size = 0, 0, 0

    def block() -> pa.RecordBatch:
        ids, n = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
        offsets = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first]), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(n)), pa.array([squeeze.compress(b"".join(x for h in held for x in h[2]))], pa.binary())],
            ["_part", "_first", "_id", "_n", "_ids"],
        )

    for batch in source:
        n = np.asarray(batch.column(2), dtype=np.int64)
        group = (size + np.cumsum(n) - n) // BLOCK_IDS
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            if held and g:
                yield block()
                first, size, held = first + size, 0, []
            part = batch.column(0)[int(at[0])].as_py()
            held.append((batch.column(1).slice(int(at[0]), len(at)), n[at], [expand.decompress(x.as_py()) for x in batch.column(3).slice(int(at[0]), len(at))]))
            size += int(n[at].sum())
    if held:
        yield block()


def token_stream(docs: DataFrame, vocab: str, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(staged blocks of the stream, ids before each part): (_part, _first, _id array, _n array, _ids), ``_first`` counting from the part's beginning."""
    id_type, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTITIONS))

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, enc, seen = zstandard.ZstdCompressor(level=3), encoder(vocab), {}
        end = np.asarray([END_OF_TEXT], dtype="<u2").tobytes()
        for batch in source:
            for piece in pieces(batch):
                ids = [enc.ids(t) for t in piece.column(2).to_pylist()]
                lot = []
                for k in piece.column(1).to_pylist():
                    seen[k] = times = seen.get(k, -1) + 1
                    lot.append(times // COPIES)
                n = np.asarray([len(x) + 1 if len(x) else 0 for x in ids], dtype=np.int64)
                out = pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lot, pa.int32()), pa.array(n), pa.array([squeeze.compress(x.tobytes() + end) for x in ids], pa.binary())], ["_id", "_k", "_lot", "_n", "_ids"])
                yield out.filter(pa.array(n > 0))

    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_k"), F.col(f"`{text_col}`").alias("_text"))
    encoded = source.mapInArrow(encode, f"_id {id_type}, _k long, _lot int, _n long, _ids binary").withColumn("_h", F.xxhash64("_k", "_lot"))
    ranged = encoded.withColumn("_part", F.floor((F.col("_h") / 2.0**64 + 0.5) * parts).cast("int")).withColumn("_part", F.least("_part", F.lit(parts - 1)))
    ordered = ranged.repartitionById(parts, "_part").sortWithinPartitions("_h", "_k", "_id", "_n").select("_part", "_id", "_n", "_ids")
    stream = staged(ordered.mapInArrow(_blocks, f"_part int, _first long, _id array<{id_type}>, _n array<long>, _ids binary"), "token-stream")
    sizes = np.zeros(parts + 1, dtype=np.int64)
    for r in stream.groupBy("_part").agg(F.sum(F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect():
        sizes[r["_part"] + 1] = r["n"]
    return stream, np.cumsum(sizes)


def placed(first: int, n: np.ndarray, o: Order, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, piece of it, slot, first id in the sequence, ids) of the stretches of documents of ``n`` ids each that lie in one sequence; ``first`` is where they begin in the stream."""
    end = first + np.cumsum(n)
    start = end - n
    count = (end - 1) // length - start // length + 1
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    number = start[doc] // length + piece
    a, z = np.maximum(start[doc], number * length), np.minimum(end[doc], (number + 1) * length)
    return doc, piece, permute(number, o), a - number * length, z - a


def written_sequences(
    docs: DataFrame, folder: str | None = None, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: str = KEY, vocab: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all shards and return (id, piece, slot, shard, offset, n_tokens, tokens, path): where each stretch of each document lies, a row for each sequence that it reaches into.

    Writes at once, to ``folder`` (any address that PyArrow has a file system for), by default a new one in the shared folder; beside each shard is its SHA-256.
    ``tokens`` are the stretch's ``n_tokens`` little-endian 16-bit ids, the one that ends a document included, read from byte ``offset`` of the shard at ``path`` when the result is used.
    Null and empty texts have no ids. Several texts of one id are documents of their own. A text of any length is encoded whole. Other columns aren't
    read, so their names can't clash. An empty table gives an empty result and no shard. Slots depend on ids, texts and the key, not on partitions; only
    of rows equal in id and text, those beyond ``COPIES`` in one task are placed by task.

    A shard is written under another name and moved when it is whole, so a task that is run again leaves the same file.
    """
    root = folder or f"{shared_dir(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    system, _ = open_folder(root)
    id_type = dict(docs.dtypes)[id_col]
    stream, before = token_stream(docs, vocab, id_col, text_col)
    total = -(-int(before[-1]) // length)
    o, held = order(total, key), docs.sparkSession.sparkContext.broadcast(before)
    shards = max(1, -(-total // shard_sequences))

    def spread(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, expand = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for batch in source:
            for row in range(batch.num_rows):
                ids = np.frombuffer(expand.decompress(batch.column(4)[row].as_py()), dtype="<u2")
                n = batch.column(3)[row].values.to_numpy()
                doc, piece, slot, at, size = placed(int(held.value[batch.column(0)[row].as_py()]) + batch.column(1)[row].as_py(), n, o, length)
                begin = np.cumsum(size) - size
                by = np.lexsort((slot, slot // shard_sequences))
                doc, piece, slot, at, size, begin = (x[by] for x in (doc, piece, slot, at, size, begin))
                moved = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(ids))]
                shard = slot // shard_sequences
                cut = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(shard))
                sums = np.concatenate(([0], np.cumsum(size)))
                lists = [batch.column(2)[row].values.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(slot % shard_sequences, pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32())]
                blobs = [squeeze.compress(moved[sums[a] : sums[z]].tobytes()) for a, z in zip(cut, cut[1:])]
                offsets = pa.array(cut, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]], pa.int32()), *(pa.ListArray.from_arrays(offsets, x) for x in lists), pa.array(blobs, pa.binary())], ["_shard", "_id", "_piece", "_slot", "_at", "_n", "_ids"])

    def finish(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Put a shard together and write it; the rows of its index by slot."""
        import zstandard

        expand, at_root = zstandard.ZstdDecompressor(), open_folder(root)[1]
        ids, piece, slot, at, n = (pa.concat_arrays([b.column(c).flatten() for b in rows]) for c in range(1, 6))
        slot, at, n = (np.asarray(x, dtype=np.int64) for x in (slot, at, n))
        whole = min(shard_sequences, total - shard * shard_sequences) * length
        body = np.full(whole, END_OF_TEXT, dtype="<u2")
        flat = np.frombuffer(b"".join(expand.decompress(x.as_py()) for b in rows for x in b.column(6)), dtype="<u2")
        to = slot * length + at
        body[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        if whole - len(flat) >= length:
            raise ValueError(f"shard {shard} lacks ids")
        path = posixpath.join(at_root, shard_name(shard))
        data = memoryview(body.view(np.uint8))
        for name, content in ((path, data), (f"{path}.sha256", f"{hashlib.sha256(data).hexdigest()}  {shard_name(shard)}\n".encode())):
            hidden = posixpath.join(at_root, f".{uuid.uuid4().hex}")
            with system.open_output_stream(hidden) as f:
                f.write(content)
            system.move(hidden, name)
        by = pa.array(np.argsort(to, kind="stable"))
        first = np.full(len(to), shard * shard_sequences) + slot
        columns = [ids, piece, pa.array(first), pa.array(np.full(len(to), shard), pa.int32()), pa.array(to * 2), n_of(n), pa.array([f"{root.rstrip('/')}/{shard_name(shard)}"] * len(to))]
        return pa.RecordBatch.from_arrays([c.take(by) for c in columns], [*_PLACE, "path"])

    def n_of(n: np.ndarray) -> pa.Array:
        return pa.array(n, pa.int32())

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system.create_dir(open_folder(root)[1], recursive=True)
        shard, rows = None, []
        for batch in source:
            of = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    if rows and int(of[a]) != shard:
                        yield finish(shard, rows)
                        rows = []
                    shard = int(of[a])
                    rows.append(batch.slice(a, z - a))
        if rows:
            yield finish(shard, rows)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, data = None, b""
        for batch in source:
            tokens = []
            for at, n, of in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                if of != path:
                    own, place = open_folder(of)
                    with own.open_input_file(place) as f:
                        path, data = of, f.read()
                if at + n * 2 > len(data):
                    raise ValueError(f"{of} ends before byte {at + n * 2}")
                tokens.append(data[at : at + n * 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(tokens, pa.binary()), batch.column(6)], [*_PLACE, "tokens", "path"])

    schema = f"_id {id_type}, piece int, slot long, shard int, offset long, n_tokens int"
    partitions = min(shards, MAX_PARTITIONS)
    spread_out = stream.mapInArrow(spread, f"_shard int, _id array<{id_type}>, _piece array<int>, _slot array<int>, _at array<int>, _n array<int>, _ids binary")
    met = spread_out.repartitionById(partitions, (F.col("_shard").cast("long") * partitions / shards).cast("int")).sortWithinPartitions("_shard")
    index = staged(met.mapInArrow(write, f"{schema}, path string"), "token-index")
    return index.mapInArrow(read, f"{schema}, tokens binary, path string").select(F.col("_id").alias(id_col), *_PLACE[1:], "tokens", "path")


def read_slots(folder: str, slot: int, count: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> np.ndarray:
    """(up to count, length) ids of consecutive slots from ``slot`` on: a resumed sequential read."""
    from pyarrow import fs

    (system, root), found = open_folder(folder), []
    while count > 0:
        path = posixpath.join(root, shard_name(slot // shard_sequences))
        if system.get_file_info(path).type != fs.FileType.File:
            break
        at = slot % shard_sequences
        with system.open_input_file(path) as f:
            f.seek(at * length * 2)
            ids = np.frombuffer(f.read(min(count, shard_sequences - at) * length * 2), dtype="<u2").reshape(-1, length)
        if not len(ids):
            break
        found.append(ids)
        slot, count = slot + len(ids), count - len(ids)
    return np.concatenate(found) if found else np.zeros((0, length), dtype="<u2")
