"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment.

Each template's words are hashed in runs of ``GRAM``; of every ``WINDOW`` consecutive hashes the least is kept (the rightmost of equals)
and goes to the index. A document's runs are all looked up, so any stretch of ``GRAM + WINDOW - 1`` words in common with a
template is found. Look-ups of one template on near diagonals form a candidate, which is aligned with the template by dynamic
programming in a band around them; what matches gives the coverage of the template and the span in the document. The text left and
right of a match is aligned again, so copies that follow each other closely are all found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._rows import arrow_pass
from loomgraph.llm._text import mix64, words
from loomgraph.llm.license_texts import TEMPLATES, Template

#: Words of a hashed run, runs of a winnowing window, half width of the band, and least coverage that is reported.
GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.6


class Index(NamedTuple):
    """Templates' words, and the inverted index: sorted run hashes with template and position."""

    names: list[str]
    templates: list[np.ndarray]
    vocab: np.ndarray
    gram: np.ndarray
    template: np.ndarray
    position: np.ndarray
    needs: list[np.ndarray]
    bars: list[np.ndarray]


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of every run of ``size`` word hashes."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(31) + h[i : len(h) - size + 1 + i])
    return out


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each ``window`` consecutive ones; ties go to the right."""
    if not len(g):
        return np.zeros(0, dtype=np.int64)
    picked = set()
    for at in range(max(1, len(g) - window + 1)):
        part = g[at : at + window]
        picked.add(at + len(part) - 1 - int(np.argmin(part[::-1])))
    return np.asarray(sorted(picked))


def build_index(templates: dict[str, str | Template]) -> Index:
    """The inverted index of templates. A template with fewer words than a run is left out."""
    names, hashed, needs, bars = [], [], [], []
    for name, given in templates.items():
        given = given if isinstance(given, Template) else Template(given)
        h = words([given.text]).hash
        if len(h) >= GRAM:
            names.append(name)
            hashed.append(h)
            needs.append(words([" ".join(given.needs)]).hash)
            bars.append(words([" ".join(given.bars)]).hash)
    rows = [(g[p], i, p) for i, h in enumerate(hashed) for g in [grams(h)] for p in winnow(g)]
    rows.sort(key=lambda r: (int(r[0]), r[1], int(r[2])))
    none = np.zeros(0, dtype=np.uint64)
    return Index(names, hashed, np.unique(np.concatenate([none, *hashed])), np.asarray([r[0] for r in rows], dtype=np.uint64), np.asarray([r[1] for r in rows], dtype=np.int64), np.asarray([r[2] for r in rows], dtype=np.int64), needs, bars)


@lru_cache(maxsize=1)
def _default() -> Index:
    return build_index(TEMPLATES)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first and end of the matched stretch of ``text``) of the best alignment on diagonals ``low`` to ``high``.

    A diagonal is the position in the text less that in the template. A match scores 2, a gap or mismatch -1; both ends of the text are free, and the alignment with the highest
    score, then the earliest end, counts.
    """
    width = high - low + 1
    score = np.zeros(width + 2, dtype=np.int64)
    score[0] = score[-1] = -(1 << 30)
    matched, start = np.zeros(width + 2, dtype=np.int64), np.full(width + 2, -1, dtype=np.int64)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        new_score, new_matched, new_start = score.copy(), matched.copy(), start.copy()
        for d in range(1, width + 1):
            j = i + low + d - 1
            if not 0 <= j < len(text):
                options = [(score[d + 1] - 1, matched[d + 1], start[d + 1])] if j < 0 or d < width else [(score[d] - 1, matched[d], start[d])]
                new_score[d], new_matched[d], new_start[d] = max(options[0][0], 0), options[0][1] if options[0][0] > 0 else 0, options[0][2] if options[0][0] > 0 else -1
                continue
            same = text[j] == word
            a = score[d] + (2 if same else -1)  # both advance
            b = score[d + 1] - 1  # a word of the template is missing
            c = new_score[d - 1] - 1  # a word of the text is extra
            top = max(a, b, c, 0)
            if top == 0:
                new_score[d], new_matched[d], new_start[d] = 0, 0, -1
            elif top == a:
                new_score[d], new_matched[d] = a, matched[d] + same
                new_start[d] = start[d] if start[d] >= 0 else (j if same else -1)
                if same and (a > best[0]):
                    best = (int(a), int(new_matched[d]), int(new_start[d]), j + 1)
            elif top == b:
                new_score[d], new_matched[d], new_start[d] = b, matched[d + 1], start[d + 1]
            else:
                new_score[d], new_matched[d], new_start[d] = c, new_matched[d - 1], new_start[d - 1]
        score, matched, start = new_score, new_matched, new_start
    return best[1], best[2], best[3]


class Hit(NamedTuple):
    """A template found in a text: its number, share of its words matched, first word and end of the span."""

    template: int
    coverage: float
    start: int
    end: int


def find(h: np.ndarray, index: Index, coverage: float = COVERAGE) -> list[Hit]:
    """The templates in a text of word hashes, by position.

    Of overlapping finds of one template the best counts. A find without the words that its template needs, or with one that it bars, doesn't count. Of
    templates whose finds overlap by over half of the shorter one, that with most words matched counts, then the higher coverage, then the earlier template.
    """
    g = grams(h)
    left, right = np.searchsorted(index.gram, g, side="left"), np.searchsorted(index.gram, g, side="right")
    at = np.flatnonzero(right > left)
    seeds: dict[int, list[tuple[int, int]]] = {}
    for p in at.tolist():
        for k in range(left[p], right[p]):
            seeds.setdefault(int(index.template[k]), []).append((p - int(index.position[k]), p))
    out: list[Hit] = []
    for template, found in seeds.items():
        mine: list[Hit] = []
        for group in _groups(found, len(index.templates[template])):
            mine += _aligned(template, index.templates[template], h, group, coverage)
        mine.sort(key=lambda x: (-x.coverage, x.start))
        kept: list[Hit] = []  # by start; they don't overlap, so only the neighbours can touch another one
        for x in mine:
            k = bisect_left(kept, x.start, key=lambda y: y.start)
            if (not k or kept[k - 1].end <= x.start) and (k == len(kept) or x.end <= kept[k].start):
                kept.insert(k, x)
        out += [x for x in kept if np.isin(index.needs[template], h[x.start : x.end]).all() and not np.isin(index.bars[template], h[x.start : x.end]).any()]
    return _best(out, [len(t) for t in index.templates])


def _best(found: list[Hit], size: list[int]) -> list[Hit]:
    """What is left of overlapping finds of several templates, by position."""
    kept: list[Hit] = []  # by start
    longest = max((x.end - x.start for x in found), default=0)
    for x in sorted(found, key=lambda x: (-round(x.coverage * size[x.template]), -x.coverage, x.template, x.start)):
        k = bisect_left(kept, x.start - longest, key=lambda y: y.start)
        while k < len(kept) and kept[k].start < x.end:
            y = kept[k]
            if 2 * (min(x.end, y.end) - max(x.start, y.start)) > min(x.end - x.start, y.end - y.start):
                break
            k += 1
        else:
            kept.insert(bisect_left(kept, (x.start, x.template), key=lambda y: (y.start, y.template)), x)
    return kept


def _groups(seeds: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Seeds (diagonal, position) chained by diagonals at most ``BAND`` apart; a chain of many copies is cut into pieces that overlap.

    An alignment of a template of ``size`` words with a positive score drifts over fewer than 2 * size diagonals, so one of the pieces holds it.
    """
    seeds = sorted(seeds)
    chains = [[seeds[0]]]
    for s in seeds[1:]:
        if s[0] - chains[-1][-1][0] <= BAND:
            chains[-1].append(s)
        else:
            chains.append([s])
    step, out = 2 * size + BAND, []
    for chain in chains:
        if chain[-1][0] - chain[0][0] <= 2 * step:
            out.append(chain)
            continue
        for low in range(chain[0][0], chain[-1][0] - step + 1, step):
            a, b = bisect_left(chain, (low,)), bisect_left(chain, (low + 2 * step + 1,))
            if a < b:
                out.append(chain[a:b])
    return out


def _aligned(template: int, words_of: np.ndarray, h: np.ndarray, group: list[tuple[int, int]], coverage: float) -> list[Hit]:
    """Every find on the diagonals of a group: the best alignment, then those in the text left and right of it, and so on."""
    own, times = np.unique(words_of, return_counts=True)
    low, high = group[0][0] - BAND, group[-1][0] + BAND
    out, rest = [], [(max(0, low), min(len(h), high + len(words_of) + BAND), group)]
    while rest:
        a, z, seeds = rest.pop()
        # The words in common, each as often as both have it, bound what can match.
        at = np.minimum(np.searchsorted(own, h[a:z]), len(own) - 1)
        if not seeds or np.minimum(np.bincount(at[own[at] == h[a:z]], minlength=len(own)), times).sum() < coverage * len(words_of):
            continue
        low, high = max(min(s[0] for s in seeds) - BAND, a - len(words_of) + 1), min(max(s[0] for s in seeds) + BAND, z - 1)
        n, s, e = align(words_of, h[a:z], low - a, high - a)
        if not n:
            continue
        if n >= coverage * len(words_of):
            out.append(Hit(template, n / len(words_of), a + s, a + e))
        rest += [(a, a + s, [x for x in seeds if x[1] < a + s]), (a + e, z, [x for x in seeds if x[1] + GRAM > a + e])]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str | Template] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, start_word, end_word, matched_text) of each template found in each document.

    Templates are texts, by default those of ``license_texts``, some with words that a find needs or mustn't hold. Finds of one template don't overlap, those next to each other all count; of
    several templates that claim the same stretch, the one with most words matched does, with ties as in ``find``.
    Words are numbered from 0 in the lower-cased text; ``matched_text`` is the span in lower case. Null and empty texts have no row;
    repeated rows come out alike, once for each. Long texts are scanned whole. Other columns aren't read, so their names can't
    clash. An empty table gives an empty result. No shuffle.
    """
    id_type = dict(docs.dtypes)[id_col]
    given = build_index(templates) if templates is not None else None

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = given or _default()
        w = words(batch.column(1).to_pylist())
        bounds = np.searchsorted(w.doc, np.arange(batch.num_rows + 1))
        # Only documents with some run of template words that the index has are looked at one by one.
        known = np.flatnonzero(np.isin(grams(w.hash), index.gram)) if len(index.gram) else np.zeros(0, dtype=np.int64)
        known = known[w.doc[known] == w.doc[known + GRAM - 1]]
        of, rows = [], []
        for d in np.unique(w.doc[known]).tolist():
            a, b = bounds[d], bounds[d + 1]
            for x in find(w.hash[a:b], index, coverage):
                of.append(d)
                rows.append((index.names[x.template], x.coverage, x.start, x.end, w.data[w.start[a + x.start] : w.end[a + x.end - 1]].tobytes().decode("utf-8", "replace")))
        cols = list(zip(*rows)) if rows else [[], [], [], [], []]
        kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], [id_col, "license", "coverage", "start_word", "end_word", "matched_text"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    return arrow_pass(source, scan, f"`{id_col}` {id_type}, license string, coverage double, start_word int, end_word int, matched_text string")
