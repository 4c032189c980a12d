"""Vectorised text helpers for batches of documents (NumPy over UTF-8 bytes).

A batch of texts is joined into one byte array with a newline after each text, so that one
pass of array operations serves every document of an Arrow batch.  Words are maximal
runs of ASCII letters, digits and bytes of non-ASCII characters, taken from the lower-cased
text; every other byte separates words.  A null text has no words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Spans of more bytes than this are hashed one by one.
_LONG = 256
_MASK = np.asarray([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of an array of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a batch. ``doc`` is each word's text number, ``start``/``end`` are byte offsets in ``data``."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_start: np.ndarray


def words(texts: list[str | None]) -> Words:
    """Hash every word of every text of a batch."""
    parts = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts) + b"\n"
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    text_start = np.cumsum(lengths) - lengths
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = _WORD[data]  # the last byte is no part of a word
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    count = np.diff(np.append(np.searchsorted(start, text_start), len(start)))
    return Words(span_hash(data, start, end), np.repeat(np.arange(len(parts)), count), start, end, data, text_start)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each [start, end). A hash depends on its bytes alone.

    Spans are read eight bytes at a time, all together; the few long ones are hashed by themselves.
    """
    size = end - start
    out = mix64(size.astype(np.uint64) * _MULT)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    long = np.flatnonzero(size > _LONG)
    left = np.flatnonzero((size > 0) & (size <= _LONG)) if len(long) else np.flatnonzero(size > 0)
    at = 0
    while len(left):
        rest = size[left] - at
        out[left] = mix64((out[left] ^ (eight[start[left] + at] & _MASK[np.minimum(rest, 8)])) * _MULT + np.uint64(1))
        left, at = left[rest > 8], at + 8
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def doc_bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets o with the items of text i at [o[i], o[i + 1])."""
    return np.searchsorted(doc, np.arange(n + 1))
