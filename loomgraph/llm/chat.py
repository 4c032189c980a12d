"""Chat formatting in budgeted windows of whole turns.

A conversation's turns become token ids: a role line, the text and an end of turn. Prefix sums of the turns' tokens choose
the windows: each holds the system turn, up to ``HISTORY`` tokens of turns that an earlier window has already had, and then
as many new turns as the budget allows. Windows begin and end with turns. The loss mask is 1 on the assistant's new turns alone: what is
repeated as history, the system turn and the user's turns are masked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._tokens import DEFAULT_VOCAB, END_OF_TEXT, encoder

#: Tokens of a window and most tokens of repeated history in it.
BUDGET, HISTORY = 512, 128


class Window(NamedTuple):
    """Turn numbers: first repeated turn, first new turn, end of the new turns."""

    history: int
    start: int
    end: int


def windows(sizes: list[int], system: int, budget: int = BUDGET, history: int = HISTORY) -> list[Window]:
    """Windows over turns of the given sizes (without the system turn of ``system`` tokens).

    A turn that exceeds the room by itself has a window of its own without history; its ids are cut into several windows later.
    """
    sums = np.concatenate(([0], np.cumsum(sizes)))
    room, out, start = max(budget - system, 1), [], 0
    while start < len(sizes):
        first = start
        while first > 0 and sums[start] - sums[first - 1] <= history and sums[start + 1] - sums[first - 1] <= room:
            first -= 1
        end = max(int(np.searchsorted(sums, sums[first] + room, side="right")) - 1, start + 1)
        out.append(Window(first, start, end))
        start = end
    return out


def format_conversation(turns: list[tuple[str, np.ndarray]], budget: int = BUDGET, history: int = HISTORY) -> list[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(first repeated, first new, end, part, ids, mask) of each window of (role, ids) turns in order; numbers leave out the system turn.

    A leading system turn is in every window, up to half the budget. The rest of a longer one comes first, in windows of no turns: parts that
    follow its first half budget, all masked. A turn that alone exceeds the room is cut into parts.
    """
    system = turns[0][1] if turns and turns[0][0] == "system" else np.zeros(0, dtype=np.int64)
    rest = turns[1:] if len(system) else turns
    out = []
    if len(system) > budget // 2:
        system, tail = system[: budget // 2], system[budget // 2 :]
        room = budget - len(system)
        for part, at in enumerate(range(0, len(tail), room)):
            ids = np.concatenate((system, tail[at : at + room]))
            out.append((0, 0, 0, part, ids, np.zeros(len(ids), dtype=np.uint8)))
    if not rest and len(system):
        return out or [(0, 0, 0, 0, system, np.zeros(len(system), dtype=np.uint8))]
    for w in windows([len(ids) for _, ids in rest], len(system), budget, history):
        body = [ids for _, ids in rest[w.history : w.end]]
        mask = [np.full(len(ids), int(role == "assistant" and k >= w.start), dtype=np.uint8) for k, (role, ids) in enumerate(rest[w.history : w.end], w.history)]
        ids, on = np.concatenate(body), np.concatenate(mask)
        room = max(budget - len(system), 1)
        for part, at in enumerate(range(0, len(ids), room)):
            piece = ids[at : at + room]
            out.append((w.history, w.start, w.end, part, np.concatenate((system, piece)), np.concatenate((np.zeros(len(system), dtype=np.uint8), on[at : at + room]))))
    return out


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(conv_id, window, first_turn, new_turn, end_turn, part, n_tokens, n_targets, tokens, mask) of every window of every conversation.

    ``conversations`` has conv_id, turn, role and text. Turns go by number (null first), then role and text; a row that occurs more than
    once counts once. Rows with a null role or text have no turn; a null conversation id is one conversation. A conversation
    without turns has no window. A system turn of over half the budget has windows of its own for the rest of it
    (no turns, ``part`` from 0), and any other turn that exceeds the room is cut into parts: no token is left out. Several system turns
    are one, in order. ``first_turn``, ``new_turn`` and ``end_turn`` count turns after the system turn. Other columns aren't
    read, so their names can't clash. An empty table gives an empty result.
    """
    id_type = dict(conversations.dtypes)["conv_id"]
    rows = conversations.select("conv_id", "turn", "role", "text").filter("role IS NOT NULL AND text IS NOT NULL")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))

    def form(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in source:
            of, cols = [], [[] for _ in range(9)]
            for row in range(batch.num_rows):
                turns = [(t["role"], np.append(enc.ids(f"<{t['role']}>\n{t['text']}"), END_OF_TEXT)) for t in batch.column(1)[row].as_py()]
                turns.sort(key=lambda t: t[0] != "system")  # a stable sort: system turns come first
                for k, (first, new, end, part, ids, mask) in enumerate(format_conversation(_one_system(turns), budget, history)):
                    of.append(row)
                    for c, v in zip(cols, (k, first, new, end, part, len(ids), int(mask.sum()), ids.astype("<u2").tobytes(), mask.tobytes())):
                        c.append(v)
            kinds = [pa.int32()] * 7 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], _NAMES)

    schema = f"conv_id {id_type}, window int, first_turn int, new_turn int, end_turn int, part int, n_tokens int, n_targets int, tokens binary, mask binary"
    return grouped.mapInArrow(form, schema)


_NAMES = ["conv_id", "window", "first_turn", "new_turn", "end_turn", "part", "n_tokens", "n_targets", "tokens", "mask"]


def _one_system(turns: list[tuple[str, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
    """Several system turns as one."""
    system = [ids for role, ids in turns if role == "system"]
    rest = [t for t in turns if t[0] != "system"]
    return [("system", np.concatenate(system)), *rest] if system else rest
