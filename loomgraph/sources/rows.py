"""Rows of the property graph as a parser makes them for one file."""

from __future__ import annotations

import json
from typing import Any

from loomgraph.operators.schema import make_key


class FileRows:
    """Collects the nodes and edges of one file in the order in which they are found."""

    def __init__(self, path: str, language: str) -> None:
        self.path, self.language = path, language
        self.nodes: list[dict[str, Any]] = []
        self.edges: list[dict[str, Any]] = []

    @property
    def base(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def node(
        self, kind: str, name: str, first: int = 0, last: int = 0, symbol: str | None = None, parent: str = "", params: str = "", returns: str = "", modifiers: str = "", test: bool = False,
        extra: dict | None = None,
    ) -> str:
        """Add a node and return its key; ``symbol`` is the key's part after the path where it isn't the name."""
        key = make_key(self.path, kind, name if symbol is None else symbol)
        self.nodes.append(
            {
                "kind": kind, "name": name, "qualified_name": key, "file_path": self.path, "line_start": first, "line_end": last, "language": self.language, "parent_name": parent,
                "params": params, "return_type": returns, "modifiers": modifiers, "is_test": test, "extra": json.dumps(extra or {}, ensure_ascii=False),
            }
        )
        return key

    def edge(self, kind: str, source: str, target: str, line: int = 0, extra: dict | None = None, probe: str | None = None, found: str | None = None) -> None:
        """Add an edge. If a file ``probe`` is among those that are parsed, the target is ``found`` instead."""
        self.edges.append({"kind": kind, "source_qualified": source, "target_qualified": target, "file_path": self.path, "line": line, "extra": json.dumps(extra or {}, ensure_ascii=False), "probe": probe, "found": found})
