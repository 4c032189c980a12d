"""Quality rule: lines marked as content or boilerplate by a linear-chain conditional random field.

Each line has features of its own (character classes, length, repeats within the document). A chain over the lines of a document
with two states, content and boilerplate, is decoded by Viterbi's algorithm. Documents keep their place if content lines make up
at least ``MIN_SHARE`` of their characters.

Labels are given for documents, not lines. Training takes a bounded sample of labelled documents (``TRAIN_DOCS``): a
logistic model of lines, taught with the label of their document, first marks which lines of the rejected documents are the bad
ones; the field then learns its weights and transitions from these lines by gradient ascent on the likelihood.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import PIECE_CHARS, packed, unpacked
from loomgraph.llm._text import span_hash, words

#: Labelled documents that training takes, those with the least hash of their id; a bound on the driver's work, not on the decoding.
TRAIN_DOCS = 3000
#: Share of a document's characters that must be in content lines.
MIN_SHARE = 0.5
#: What a text that isn't empty has.
INK = "[^ \\n\\t\\r]"
FEATURES = ("bias", "length", "upper", "digit", "symbol", "mark", "bar", "shout", "word", "same", "repeat", "blank", "short")

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 white space and control
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#$%&*+=<>@^_~\\{}[]/`"]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
_CLASS[128:] = 8


class Lines(NamedTuple):
    """Lines of a batch: features, characters (bytes), and offsets of each text's lines."""

    x: np.ndarray
    size: np.ndarray
    bounds: np.ndarray


def line_features(texts: list[str | None]) -> Lines:
    """Features of every line of every text. An empty text has one blank line, a null one none."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    end = np.flatnonzero(data == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    doc = np.searchsorted(np.cumsum(lengths), start, side="right")
    present = np.fromiter((t is not None for t in texts), dtype=bool, count=len(texts))[doc]
    size = end - start
    count = np.bincount(np.repeat(np.arange(len(end)) * 9, size + 1) + _CLASS[data], minlength=len(end) * 9).reshape(-1, 9).astype(np.float64)
    count[:, 0] -= 1  # the newline
    ink = np.maximum(size - count[:, 0], 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    h = span_hash(data, start, end)
    order = np.lexsort((h, doc))
    edge = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
    group = np.cumsum(edge) - 1
    times = np.empty(len(h))
    times[order] = np.bincount(group)[group]
    w = words(texts)
    line = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
    again = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1]))) if len(line) else np.zeros(0, dtype=bool)
    same = np.bincount(line, again, minlength=len(size)) / np.maximum(np.bincount(line, minlength=len(size)), 1)
    blank = (size == count[:, 0]).astype(np.float64)
    x = np.stack(
        [
            np.ones(len(size)), np.log1p(size) / 5, count[:, 2] / letters, count[:, 3] / ink, count[:, 4] / ink, count[:, 5] / ink, count[:, 6] / ink, count[:, 7] / ink,
            np.minimum(ink / (count[:, 0] + 1), 20) / 10, np.sqrt(same), np.log(times) * (1 - blank), blank, (size < 20).astype(np.float64),
        ],
        axis=1,
    )
    x[:, 4:8] = np.sqrt(x[:, 4:8])
    counts = np.bincount(doc[present], minlength=len(texts))
    return Lines(x[present], size[present], np.concatenate(([0], np.cumsum(counts))))


class Field(NamedTuple):
    """Weights of the state boilerplate against content for each feature, transition scores [from, to], and the least share."""

    w: np.ndarray
    t: np.ndarray
    min_share: float


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Texts from the longest to the shortest, and for each line number how many of them have it."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max(initial=0))
    return order, np.searchsorted(-n[order], -np.arange(longest), side="left").tolist()


def viterbi(lines: Lines, field: Field) -> np.ndarray:
    """The most likely state of every line: True for boilerplate. Ties go to content."""
    e = lines.x @ field.w
    out = np.zeros(len(e), dtype=bool)
    order, alive = _steps(lines.bounds)
    if not alive:
        return out
    at = lines.bounds[:-1][order]
    back = np.zeros((len(e), 2), dtype=bool)
    score = np.stack([np.zeros(alive[0]), e[at[: alive[0]]]], axis=1)
    final = np.zeros((len(order), 2))
    final[: alive[0]] = score
    for k, n in enumerate(alive[1:], 1):
        come = score[:n, :, None] + field.t
        prev = come[:, 1] > come[:, 0]
        here = at[:n] + k
        back[here] = prev
        score = np.where(prev, come[:, 1], come[:, 0])
        score[:, 1] += e[here]
        final[:n] = score
    state = final[:, 1] > final[:, 0]
    length = np.diff(lines.bounds)[order]
    for k in range(len(alive) - 1, -1, -1):
        n = alive[k]
        here = at[:n] + k
        going = length[:n] > k + 1
        state[:n][going] = back[here[going] + 1, state[:n][going].astype(np.int64)]
        out[here] = state[:n]
    return out


def _likelihood(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood in the weights and transitions, by the forward and backward passes."""
    e = np.stack([np.zeros(len(x)), x @ w], axis=1)
    order, alive = _steps(bounds)
    at = bounds[:-1][order]
    f, b = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    f[at[: alive[0]]] = e[at[: alive[0]]]
    for k, n in enumerate(alive[1:], 1):
        here = at[:n] + k
        f[here] = np.logaddexp(f[here - 1, 0, None] + t[0], f[here - 1, 1, None] + t[1]) + e[here]
    for k in range(len(alive) - 1, 0, -1):
        here = at[: alive[k]] + k
        go = (b[here] + e[here])[:, None, :] + t
        b[here - 1] = np.logaddexp(go[:, :, 0], go[:, :, 1])
    z = np.logaddexp(f[:, 0] + b[:, 0], f[:, 1] + b[:, 1])
    p = np.exp(f[:, 1] + b[:, 1] - z)
    g = x.T @ (y - p)
    inner = np.setdiff1d(np.arange(len(x)), bounds[:-1])
    pair = np.exp(f[inner - 1][:, :, None] + t + (e[inner] + b[inner])[:, None, :] - z[inner][:, None, None]).sum(axis=0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    return g, seen - pair


def train(texts: list[str], bad: list[bool], rounds: int = 250) -> Field:
    """The field for labelled texts; without both labels there is nothing to learn and every line is content."""
    keep = [i for i, t in enumerate(texts) if t]
    texts, flags = [texts[i] for i in keep], np.asarray([bad[i] for i in keep], dtype=bool)
    none = Field(np.asarray([-1.0] + [0.0] * (len(FEATURES) - 1)), np.zeros((2, 2)), MIN_SHARE)
    if not flags.any() or flags.all():
        return none
    lines = line_features(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(lines.bounds))
    target = flags[doc].astype(np.float64)
    # Every document weighs alike, its lines by their characters; the two labels weigh alike together.
    share = (lines.size + 1) / np.bincount(doc, lines.size + 1)[doc]
    share *= np.where(flags[doc], 0.5 / flags.sum(), 0.5 / (~flags).sum())
    w = np.zeros(lines.x.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(-(lines.x @ w)))
        h = (lines.x * (share * p * (1 - p))[:, None]).T @ lines.x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, lines.x.T @ (share * (target - p)) - 1e-4 * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    # A line of a rejected document is bad if hardly a line of the others scores like it.
    score = lines.x @ w
    y = ((score > min(0.0, np.quantile(score[target == 0], 0.995))) & (target > 0)).astype(np.float64)
    v, t, mv, mt = w.copy(), np.zeros((2, 2)), np.zeros(len(w)), np.zeros((2, 2))
    for i in range(rounds):
        g, gt = _likelihood(lines.x, y, lines.bounds, v, t)
        mv, mt = 0.9 * mv + g / len(y) - 1e-4 * v, 0.9 * mt + gt / len(y) - 1e-4 * t
        rate = 1.0 if i < rounds * 2 // 3 else 0.2
        v, t = v + rate * mv, t + rate * mt
    return Field(v, t - t.max(), MIN_SHARE)


def content(texts: list[str | None], field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, content lines, share of characters in content lines) of each text; the share of a text without characters is 1."""
    lines = line_features(texts)
    good = ~viterbi(lines, field)
    doc = np.repeat(np.arange(len(texts)), np.diff(lines.bounds))
    size = np.bincount(doc, lines.size, minlength=len(texts))
    kept = np.bincount(doc[good], lines.size[good], minlength=len(texts))
    return np.diff(lines.bounds), np.bincount(doc[good], minlength=len(texts)), np.where(size > 0, kept / np.maximum(size, 1), 1.0)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on at most ``train_docs`` labelled documents; rows with a null id, text or label are left out."""
    chosen = labels.select(F.col("doc_id").alias("_lid"), F.col("quality").alias("_q")).filter("_lid IS NOT NULL AND _q IS NOT NULL").groupBy("_lid").agg(F.min("_q").alias("_q"))
    chosen = chosen.orderBy(F.xxhash64("_lid"), "_lid").limit(train_docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).filter("_text <> ''").select("_id", "_text", "_q").distinct().orderBy("_id", "_text").limit(train_docs).toArrow()
    return train(rows["_text"].to_pylist(), [q == 0 for q in rows["_q"].to_pylist()])


def scores(text: Column, field: Field) -> Column:
    """Struct (lines, content, share) of a text column."""

    @F.pandas_udf("lines int, content int, share double")
    def decode(texts: pd.Series) -> pd.DataFrame:
        group = (texts.str.len().fillna(0).cumsum() // PIECE_CHARS).to_numpy() if len(texts) else []
        found = [content(part.tolist(), field) for _, part in texts.where(texts.notna(), None).groupby(np.asarray(group), sort=True)]
        if not found:
            return pd.DataFrame({"lines": [], "content": [], "share": []})
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("lines", "content", "share"))})

    return decode.asNondeterministic()(text)  # else a filter on a score would have it computed again for the filter


def assess(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines, content_lines, content_share, kept) of every row of ``docs``.

    Null and empty texts have no content to speak of: their share is 0 and they are rejected, as are texts of white space
    alone. A share that equals the least one is kept; between equal scores a line is content. Repeated rows come out alike; other columns
    aren't read, so their names can't clash. A document of any length is decoded whole. An empty table gives an empty result.
    """
    scored = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).withColumn("_s", scores(F.col("_text"), field))
    empty = ~F.coalesce(F.col("_text").rlike(INK), F.lit(False))
    share = F.when(empty, 0.0).otherwise(F.col("_s.share"))
    return scored.select(
        F.col("_id").alias(id_col), F.col("_s.lines").alias("lines"), F.when(empty, 0).otherwise(F.col("_s.content")).alias("content_lines"), share.alias("content_share"), (~empty & (share >= field.min_share)).alias("kept")
    )


def keep_content(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns under their names, whatever these are. An empty table stays empty. No shuffle."""
    work = packed(docs, docs.columns[0], text_col).withColumn("_s", scores(F.col("_text"), field))
    full = F.col("_text").rlike(INK)
    return unpacked(work.filter(full & (F.col("_s.share") >= field.min_share)), docs.columns)
