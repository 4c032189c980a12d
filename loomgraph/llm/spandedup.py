"""Substring deduplication by sliding spans of sentences.

A sentence ends after . ! ? ; : or , with the white space that follows, after such a mark of Chinese, Japanese, Arabic or Hindi, or at a
line end; long sentences of running text are thus compared clause by clause, which lets spans fit into a passage that was copied from the
middle of one. From every sentence on, the shortest run of at least ``SENTENCES`` sentences and ``MIN_CHARS`` characters is a span. Spans are
hashed (96 bits, lower case, outer white space ignored) and joined globally; sentences covered by any occurrence but the first go.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from loomgraph.llm._repeats import Runs, Units, gathered, without_repeats

#: Least sentences of a span, and least characters: a shorter run goes on until it has enough of both, as short lines repeat by chance.
SENTENCES = 2
MIN_CHARS = 100
#: Ends of sentences that need no white space after them.
MARKS = "。！？；：，、؟۔।"
END = f"[.!?;:,][ \\t\\r\\n]+|[{MARKS}][ \\t\\r\\n]*|\\n[ \\t\\r\\n]*"
_END = re.compile(END)
_END_BYTES = re.compile(b"[.!?;:,][ \\t\\r\\n]+|(?:" + b"|".join(m.encode() for m in MARKS) + b")[ \\t\\r\\n]*|\\n[ \\t\\r\\n]*")


def sentences(text: str) -> list[str]:
    """The sentences of a text with what follows each; joined they give the text."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _sentences(texts: list[str]) -> Units:
    """The sentences of texts as they are compared."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    u = gathered(parts, [[m.end() for m in _END_BYTES.finditer(p)] for p in parts])
    ink = np.append(np.flatnonzero((u.data != 32) & (u.data != 9) & (u.data != 10) & (u.data != 13)), len(u.data))
    start = ink[np.searchsorted(ink, u.start)]
    last = np.searchsorted(ink, u.end) - 1
    end = np.where(last >= 0, ink[np.maximum(last, 0)] + 1, 0)
    some = start < u.end
    return u._replace(start=np.where(some, start, u.start), end=np.where(some, end, u.start))


def spans(u: Units, count: int = SENTENCES, min_chars: int = MIN_CHARS) -> Runs:
    """From each sentence the shortest run of one text with ``count`` sentences and ``min_chars`` characters, where there is one."""
    chars = np.concatenate(([0], np.cumsum((u.data & 0xC0) != 0x80)))
    sums = np.concatenate(([0], np.cumsum(chars[u.end] - chars[u.start])))
    first = np.arange(len(u.start))
    end = np.maximum(np.searchsorted(sums, sums[:-1] + min_chars), first + count)
    fits = end <= u.bounds[1:][u.doc] if len(first) else np.zeros(0, dtype=bool)
    return Runs(first[fits], end[fits])


def dedup_spans(
    docs: DataFrame, count: int = SENTENCES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", removed: str | None = None
) -> DataFrame:
    """``docs`` without the sentences that a repeated span covers; see ``removed`` for the other form.

    The first occurrence in order of (id, hash of the text, position) stays, null ids before others; every
    later one goes, within one document too, together with the white space after it. Documents with fewer sentences or characters than a
    span are unchanged. A null text stays null, an empty one empty; a text of which all goes becomes empty and its row
    stays. Rows equal in id and text are one document: all copies come out alike. Other columns come along under their names,
    whatever these are. With ``removed`` the result is (id, text, number of sentences removed under that name).
    An empty table gives an empty one.
    """
    return without_repeats(docs, _sentences, lambda u: spans(u, count, min_chars), sentences, "", id_col, text_col, removed)
