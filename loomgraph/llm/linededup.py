"""Line deduplication by overlapping windows of three lines.

Each run of three consecutive lines is hashed (96 bits). A window that occurs anywhere before, in the order of document and
position, is a repeat; the lines that repeats cover are merged and left out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from loomgraph.llm._repeats import Runs, Units, gathered, without_repeats

#: Lines of a window.
LINES = 3
_BREAK = re.compile(rb"\n")


def _lines(texts: list[str]) -> Units:
    """The lines of texts, each with the break that ends it; what is compared leaves the break out."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    u = gathered(parts, [[m.end() for m in _BREAK.finditer(p)] for p in parts])
    inner = np.ones(len(u.start), dtype=np.int64)
    inner[u.bounds[1:] - 1] = 0
    return u._replace(end=u.end - inner)


def windows(u: Units, lines: int = LINES) -> Runs:
    """Every run of ``lines`` lines of one text that aren't all blank."""
    first = np.arange(max(len(u.start) - lines + 1, 0))
    doc = u.doc
    ink = np.concatenate(([0], np.cumsum(u.data != 32)))
    marks = np.concatenate(([0], np.cumsum(ink[u.end] - ink[u.start])))
    first = first[(doc[first] == doc[first + lines - 1]) & (marks[first + lines] > marks[first])]
    return Runs(first, first + lines)


def dedup_lines(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` without the lines that a repeated window of ``lines`` lines covers; see ``removed`` for the other form.

    Lines are what newlines separate, compared as they are. A window of blanks alone doesn't count. The first
    occurrence in order of (id, hash of the text, line) stays, null ids before others; every later
    one goes, within one document too. Documents with fewer lines than a window are
    unchanged. A null text stays null, an empty one empty; a text of which every line goes becomes empty and its row stays.
    Rows equal in id and text are one document: all copies come out alike. Other columns come along
    under their names, whatever these are. With ``removed`` the result is (id, text, number of
    lines removed under that name). An empty table gives an empty one.
    """
    return without_repeats(docs, _lines, lambda u: windows(u, lines), lambda t: t.split("\n"), "\n", id_col, text_col, removed)
