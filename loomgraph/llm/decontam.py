"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences.

1. One pass over the texts keeps, for each document, the words that occur in the benchmark with their positions. Everything after
   works on this table.
2. Passages are windows of two blocks of ``BLOCK`` words, a block apart. Passage frequencies over the whole corpus and the benchmark
   give TF-IDF weights.
3. A randomised SVD of the TF-IDF matrix of passages and benchmark items, distributed over the corpus, gives the latent space. One pass
   multiplies the sketch by the matrix and its transpose; Nyström's formula then gives the singular vectors. The items have as much weight
   together as the corpus, so that their directions are kept.
4. Each passage is compared with every item; a cosine of ``COSINE`` makes a candidate. So does a run of ``RUN`` words of the item, word
   for word, in an index of all items' runs: frequent words have no weight, and short items little in a passage of other words.
   Candidates with too few of the item's words around the passage can't reach 5 and are discarded.
5. A candidate is contaminated if the longest common subsequence of the item and the words around the passage covers ``COVERED`` of the
   item, and that of its answer ``ANSWERED`` of the answer. Paraphrases that keep most words in order are caught with exact copies.

The model's size depends on the benchmark alone. A benchmark of more than ``ITEMS`` items is worked off in parts of that
size, each with its own latent space, over the same table of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import arrow_pass, packed, unpacked
from loomgraph.llm._text import mix64, words
from loomgraph.operators.tables import staged

#: Words of a block; a passage has two.
BLOCK = 32
#: Dimensions of the latent space, and columns beyond them in the sketch.
RANK, OVERSAMPLE = 96, 16
#: Least cosine of a candidate, least share of the item's words and of its answer's words in the common subsequence.
COSINE, COVERED, ANSWERED = 0.45, 0.6, 0.5
#: Consecutive words in common that make a candidate whatever the cosine; an item with fewer words has to be there whole.
RUN = 3
#: The last part of an item counts as its answer.
ANSWER_SHARE = 0.25
#: Items of one latent space; with their words, they bound what is broadcast.
ITEMS = 2000
#: Words in more than this share of the passages carry no meaning and have no weight.
MAX_DF = 0.02
#: Vectors that one task adds up.
FAN_IN = 64
_SEED = 7


class Items(NamedTuple):
    """Benchmark items as numbers of words: sorted vocabulary of hashes, ids, and each item's words."""

    vocab: np.ndarray
    ids: pa.Array
    terms: list[np.ndarray]


class Runs(NamedTuple):
    """The items' runs of ``size`` words: sorted distinct keys, and for each where its items begin in ``item`` (one more at the end)."""

    size: int
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray


class Model(NamedTuple):
    """Term weights into the latent space (idf times right singular vectors) and the items' unit vectors there."""

    project: np.ndarray
    items: np.ndarray


def read_items(benchmark: DataFrame) -> list[Items]:
    """The items in parts of ``ITEMS``, by id. Items without words or id are left out; of equal ids and texts one counts."""
    rows = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text <> ''").distinct().orderBy("item_id", "text").toArrow()
    ids, texts = rows["item_id"].combine_chunks(), rows["text"].to_pylist()
    parts = []
    for at in range(0, len(ids), ITEMS):
        w = words(texts[at : at + ITEMS])
        vocab, term = np.unique(w.hash, return_inverse=True)
        lists = [term[w.doc == i].astype(np.int32) for i in range(len(texts[at : at + ITEMS]))]
        keep = [i for i, t in enumerate(lists) if len(t)]
        if keep:
            parts.append(Items(vocab, ids.take(pa.array([at + i for i in keep])), [lists[i] for i in keep]))
    return parts


def benchmark_words(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(_id, _k, n, pos, term): the words of each document that are in ``vocab``, as bytes of 32-bit positions and numbers.

    Documents without any aren't in the table; ``n`` is the number of all words.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    id_type = dict(docs.dtypes)["_id"]

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = held.value
        w = words(batch.column(2).to_pylist())
        at = np.minimum(np.searchsorted(v, w.hash), len(v) - 1)
        hit = np.flatnonzero(v[at] == w.hash)
        bounds = np.searchsorted(w.doc, np.arange(batch.num_rows + 1))
        pos, term, doc = (hit - bounds[w.doc[hit]]).astype("<i4"), at[hit].astype("<i4"), w.doc[hit]
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        some = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(np.diff(bounds)[some], pa.int32()),
                pa.array([pos[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([term[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
            ],
            ["_id", "_k", "n", "pos", "term"],
        )

    return arrow_pass(docs.select("_id", "_k", "_text"), find, f"_id {id_type}, _k long, n int, pos binary, term binary")


class Blocks(NamedTuple):
    """Blocks of some documents: each word's block and term, each block's document (row of the batch) and number in it."""

    block: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    number: np.ndarray


def blocks(pos: list[bytes], term: list[bytes], number_of: np.ndarray | None = None) -> Blocks:
    """Cut documents into blocks; blocks without a word of the vocabulary don't appear. ``number_of`` renumbers terms, -1 drops."""
    p, t = np.frombuffer(b"".join(pos), dtype="<i4"), np.frombuffer(b"".join(term), dtype="<i4")
    doc = np.repeat(np.arange(len(pos)), [len(x) // 4 for x in pos])
    if number_of is not None:
        t = number_of[t]
        keep = t >= 0
        p, t, doc = p[keep], t[keep], doc[keep]
    if not len(p):
        none = np.zeros(0, dtype=np.int64)
        return Blocks(none, none, none, none)
    key = doc.astype(np.int64) << 32 | p // BLOCK
    first = np.concatenate(([True], key[1:] != key[:-1]))
    return Blocks(np.cumsum(first) - 1, t, doc[first], (key[first] & 0xFFFFFFFF))


def block_vectors(b: Blocks, project: np.ndarray) -> np.ndarray:
    """Sum of the words' rows of ``project`` for each block: the k-th words of all blocks are added at once."""
    out = np.zeros((len(b.doc), project.shape[1]), dtype=np.float32)
    used = project.any(axis=1)[b.term]
    block, term = b.block[used], b.term[used]
    if not len(block):
        return out
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    size = np.diff(np.append(first, len(block)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    sums = project[term[first]]
    for k in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -k))
        sums[:n] += project[term[first[:n] + k]]
    out[block[first]] = sums
    return out


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of float vectors in column ``v`` over a table with one for each task; each level of the tree adds at most ``FAN_IN`` of them in a task."""

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in source:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, dtype=np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["v"])

    tasks = parts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(add, "v binary")
    grouped = parts.repartition(min(tasks, 4)).mapInArrow(add, "v binary")
    return np.sum([np.frombuffer(r.v, dtype=np.float32) for r in grouped.collect()] + [np.zeros(width)], axis=0, dtype=np.float64)


def passage_frequencies(table: DataFrame, number_of: np.ndarray, terms: int) -> tuple[np.ndarray, int]:
    """Blocks of the corpus with each term, and all blocks (those without a term too)."""
    renumber = table.sparkSession.sparkContext.broadcast(number_of)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms + 1)
        for batch in source:
            b = blocks(batch.column(1).to_pylist(), batch.column(2).to_pylist(), renumber.value)
            df[:terms] += np.bincount(np.unique(b.block * terms + b.term) % terms, minlength=terms)
            df[terms] += np.sum(-(-np.asarray(batch.column(0), dtype=np.int64) // BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms + 1)), pa.array(df)], ["term", "n"])

    sums = table.select("n", "pos", "term").mapInArrow(count, "term long, n double").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms + 1)
    df[np.asarray(sums["term"])] = np.asarray(sums["n"])
    return df[:terms], int(df[terms])


def fit(table: DataFrame, items: Items, number_of: np.ndarray, rank: int = RANK) -> Model:
    """Randomised SVD of the TF-IDF passages of the corpus and the items; the passages are rows of unit length."""
    terms = len(items.vocab)
    df, passages = passage_frequencies(table, number_of, terms)
    for t in items.terms:
        df[np.unique(t)] += 1
    passages += len(items.terms)
    idf = np.log(passages / np.maximum(df, 1)).astype(np.float32)
    idf[df > max(MAX_DF * passages, len(items.terms))] = 0
    own = np.zeros((len(items.terms), terms), dtype=np.float32)
    for i, t in enumerate(items.terms):
        np.add.at(own[i], t, 1)
    own *= idf
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    sketch = min(rank + OVERSAMPLE, terms)
    q = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((terms, sketch)))[0]
    spark = table.sparkSession
    renumber, held = spark.sparkContext.broadcast(number_of), spark.sparkContext.broadcast((idf[:, None] * q).astype(np.float32))

    def product(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((terms, sketch), dtype=np.float32), 0
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                b = blocks(part.column(0).to_pylist(), part.column(1).to_pylist(), renumber.value)
                useful = idf[b.term] > 0
                b = Blocks(b.block[useful], b.term[useful], b.doc, b.number)
                if not len(b.term):
                    continue
                # Rows of unit length, a block with a term twice counting it so.
                pair, times = np.unique(b.block * terms + b.term, return_counts=True)
                norm = np.bincount(pair // terms, (times * idf[pair % terms]) ** 2, minlength=len(b.doc))
                y = block_vectors(b, held.value) / np.maximum(norm, 1e-9)[:, None].astype(np.float32)
                rows += int((norm > 0).sum())
                order = np.argsort(b.term, kind="stable")
                t = b.term[order]
                start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                total[t[start]] += np.add.reduceat(y[b.block[order]], start, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), np.float32(rows)).tobytes()], pa.binary())], ["v"])

    got = _summed(table.select("pos", "term").mapInArrow(product, "v binary"), terms * sketch + 1)
    corpus, rows = got[:-1].reshape(terms, sketch) * idf[:, None], max(got[-1], 1.0)
    return latent_model(idf, own, q, corpus / rows + own.T @ (own @ q) / len(own), rank)


def latent_model(idf: np.ndarray, own: np.ndarray, q: np.ndarray, sketch: np.ndarray, rank: int) -> Model:
    """The model from ``sketch``, the product of the passages' Gram matrix with the orthonormal ``q``: singular vectors by Nyström's formula."""
    shift = 1e-6 * max(float(np.linalg.norm(sketch)), 1e-9)  # keeps the small matrix positive
    y = sketch + shift * q
    small = q.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift))
    v = np.linalg.svd(y @ root, full_matrices=False)[0][:, :rank]
    latent = own @ v
    return Model(np.ascontiguousarray(idf[:, None] * v, dtype=np.float32), (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def common(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence, and a mask of the words of ``a`` in one that ends earliest."""
    rows = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i, x in enumerate(a, 1):
        rows[i, 1:] = np.maximum.accumulate(np.maximum(rows[i - 1, 1:], np.where(b == x, rows[i - 1, :-1] + 1, 0)))
    mask, i, j = np.zeros(len(a), dtype=bool), len(a), len(b)
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            mask[i - 1] = True
            i, j = i - 1, j - 1
    return int(rows[-1, -1]), mask


def check(item: np.ndarray, near: np.ndarray) -> tuple[float, float]:
    """(share of the item's words, share of its answer's words) in the common subsequence with the words ``near`` a passage."""
    n, mask = common(item, near)
    answer = max(1, int(round(len(item) * ANSWER_SHARE)))
    return n / len(item), float(mask[-answer:].mean())


def scan(table: DataFrame, items: Items, number_of: np.ndarray, model: Model, item_type: str = "long") -> DataFrame:
    """(_id, _k, item, cosine, covered, answered) of contaminated documents: for each item the passage with the highest cosine that holds it, the first of equals."""
    spark = table.sparkSession
    held = spark.sparkContext.broadcast((items, number_of, model))
    id_type = dict(table.dtypes)["_id"]

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, number_of, model = held.value
        times, runs = word_counts(items), item_runs(items)
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hit = contained(part.column(2).to_pylist(), part.column(3).to_pylist(), items, number_of, model, times, runs)
                take = pa.array([h[0] for h in hit], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), items.ids.take(pa.array([h[1] for h in hit], pa.int64())), *(pa.array([h[k] for h in hit], pa.float64()) for k in (2, 3, 4))],
                    ["_id", "_k", "item", "cosine", "covered", "answered"],
                )

    return table.select("_id", "_k", "pos", "term").mapInArrow(find, f"_id {id_type}, _k long, item {item_type}, cosine double, covered double, answered double")


def word_counts(items: Items) -> np.ndarray:
    """How often each item has each word of the vocabulary; 255 stands for that and more."""
    out = np.zeros((len(items.terms), len(items.vocab)), dtype=np.uint8)
    for i, t in enumerate(items.terms):
        term, n = np.unique(t, return_counts=True)
        out[i, term] = np.minimum(n, 255)
    return out


def contained(pos: list[bytes], term: list[bytes], items: Items, number_of: np.ndarray, model: Model, times: np.ndarray, runs: list[Runs]) -> list[tuple[int, int, float, float, float]]:
    """(document, item, cosine, covered, answered) of the items that documents hold, given as ``benchmark_words`` does."""
    t = number_of[np.frombuffer(b"".join(term), dtype="<i4")]
    keep = t >= 0
    t, of = t[keep], np.repeat(np.arange(len(pos)), [len(x) // 4 for x in pos])[keep]
    place = of.astype(np.int64) << 32 | np.frombuffer(b"".join(pos), dtype="<i4")[keep]
    doc, block, item, cosine = candidates(blocks(pos, term, number_of), model, runs=shared_runs(place, t, runs))
    if not len(doc):
        return []
    size = np.asarray([len(x) for x in items.terms])[item]
    reach = size * 3 // 2
    first = np.searchsorted(place, doc << 32 | np.maximum(block * BLOCK - reach, 0))
    end = np.searchsorted(place, (doc << 32) + (block + 2) * BLOCK + reach)
    # The words in common, each as often as both have it, bound the subsequence from above.
    bound = np.zeros(len(doc))
    for at in range(0, len(doc), 10_000):
        s = slice(at, at + 10_000)
        n = end[s] - first[s]
        c = np.repeat(np.arange(len(n)), n)
        word = t[np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(len(c))]
        shared = times[item[s][c], word] > 0
        pair, count = np.unique(c[shared] * times.shape[1] + word[shared], return_counts=True)
        c, word = pair // times.shape[1], pair % times.shape[1]
        most = times[item[s][c], word]
        bound[s] = np.bincount(c, np.where(most < 255, np.minimum(count, most), count), minlength=len(n))
    able = np.flatnonzero(bound >= COVERED * size)
    out, done = [], set()
    for k in able[np.lexsort((block[able], -cosine[able]))].tolist():
        key = (int(doc[k]), int(item[k]))
        if key not in done:
            covered, answered = check(items.terms[item[k]], t[first[k] : end[k]])
            if covered >= COVERED and answered >= ANSWERED:
                done.add(key)
                out.append((*key, float(cosine[k]), covered, answered))
    return out


def run_keys(t: np.ndarray, size: int) -> np.ndarray:
    """A key for every run of ``size`` terms; runs that collide only make candidates more."""
    key = np.zeros(max(len(t) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        key = mix64(key * np.uint64(31) + t[i : len(key) + i].astype(np.uint64) + np.uint64(1))
    return key


def item_runs(items: Items) -> list[Runs]:
    """The runs of all items, by size: ``RUN``, and what shorter items have."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, t in enumerate(items.terms):
        size = min(RUN, len(t))
        by.setdefault(size, []).append((i, np.unique(run_keys(t, size))))
    out = []
    for size, found in sorted(by.items()):
        key, item = np.concatenate([k for _, k in found]), np.repeat([i for i, _ in found], [len(k) for _, k in found])
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        out.append(Runs(size, keys, np.append(first, len(key)), item[order]))
    return out


def shared_runs(place: np.ndarray, t: np.ndarray, runs: list[Runs]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, block, item), each once, of the runs of items in documents whose words ``t`` are at ``place`` (document << 32 | position)."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    for r in runs:
        key = run_keys(t, r.size)
        k = np.minimum(np.searchsorted(r.keys, key), len(r.keys) - 1)
        hit = np.flatnonzero((r.keys[k] == key) & (place[r.size - 1 :] - place[: len(key)] == r.size - 1))
        n = r.first[k[hit] + 1] - r.first[k[hit]]
        at = np.repeat(r.first[k[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where = place[hit] >> 32 << 32 | (place[hit] & 0xFFFFFFFF) // BLOCK
        found.append(np.unique(np.stack([np.repeat(where, n), r.item[at]]), axis=1))
    where, item = np.concatenate(found, axis=1)
    return where >> 32, where & 0xFFFFFFFF, item


def candidates(b: Blocks, model: Model, cosine: float = COSINE, runs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first block, item, cosine) of passages near an item: each block alone and with the one after it.

    ``runs``, as ``shared_runs`` gives them, are candidates with any cosine.
    """
    y = block_vectors(b, model.project)
    follows = np.concatenate(((b.doc[1:] == b.doc[:-1]) & (b.number[1:] == b.number[:-1] + 1), [False])) if len(y) else np.zeros(0, dtype=bool)
    row, item, cos = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
    for both in (False, True):
        at = np.flatnonzero(follows) if both else np.arange(len(y))
        v = y[at] + y[at + 1] if both else y
        size = np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        for s in range(0, len(at), 4096):
            near = v[s : s + 4096] @ model.items.T / size[s : s + 4096]
            r, i = np.nonzero(near >= cosine)
            row.append(at[s + r])
            item.append(i)
            cos.append(near[r, i])
    if runs is not None and len(runs[0]):
        width = len(model.items)
        of = np.searchsorted(b.doc.astype(np.int64) << 32 | b.number, runs[0] << 32 | runs[1])
        new = np.flatnonzero(~np.isin(of * width + runs[2], np.concatenate(row) * width + np.concatenate(item)))
        for s in range(0, len(new), 100_000):
            r, i = of[new[s : s + 100_000]], runs[2][new[s : s + 100_000]]
            row.append(r)
            item.append(i)
            cos.append(np.einsum("ij,ij->i", y[r], model.items[i]) / np.maximum(np.linalg.norm(y[r], axis=1), 1e-9))
    at = np.concatenate(row)
    return b.doc[at].astype(np.int64), b.number[at].astype(np.int64), np.concatenate(item).astype(np.int64), np.concatenate(cos)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_id, _k, item, cosine, covered, answered); ``docs`` is as ``packed`` gives it."""
    id_type = dict(docs.dtypes)["_id"]
    item_type = dict(benchmark.dtypes)["item_id"]
    schema = f"_id {id_type}, _k long, item {item_type}, cosine double, covered double, answered double"
    parts = read_items(benchmark)
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    vocab = np.unique(np.concatenate([p.vocab for p in parts]))
    table = staged(benchmark_words(docs, vocab), "benchmark-words")
    out = None
    for part in parts:
        number_of = np.full(len(vocab), -1, dtype=np.int32)
        number_of[np.searchsorted(vocab, part.vocab)] = np.arange(len(part.vocab))
        found = scan(table, part, number_of, fit(table, part, number_of), item_type)
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, covered, answered): each document with each benchmark item that it holds.

    ``covered`` and ``answered`` are the shares of the item and of its answer, the last quarter of its words, in the common
    subsequence, in the passage with the highest cosine that holds the item. Null and empty texts hold nothing; neither do items without words. Rows equal in id and text come out
    alike, once for each. Item ids keep their type; an id with several texts is several items, and repeated rows of the benchmark count once.
    Long texts count whole. Other columns aren't read, so their names can't clash. An empty table or benchmark gives an empty result.
    """
    found = contamination(packed(docs, id_col, text_col), benchmark)
    return found.select(F.col("_id").alias(id_col), F.col("item").alias("item_id"), "cosine", "covered", "answered")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``contaminated`` reports, with their columns under their names, whatever these are."""
    work = packed(docs, id_col, text_col)
    bad = contamination(work, benchmark).select(F.col("_id").alias("_id2"), F.col("_k").alias("_k2")).distinct()
    return unpacked(work.join(bad, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_k") == F.col("_k2")), "left_anti"), docs.columns)
