"""Python files: classes, functions, imports and calls, from the standard library's syntax tree.

Only statements directly in a body are looked at, so what stands under a module-level ``if`` or ``try`` isn't seen; calls are looked for
in the whole of a function. Targets of calls, imports and bases are texts, not keys. A file that can't be
parsed has its File node alone, with ``parse_error``. ``async`` is no modifier, and imports from ``__future__`` are no edges.
"""

from __future__ import annotations

import ast
import io
import tokenize
from bisect import bisect_left
from collections.abc import Iterator

from loomgraph.sources.rows import FileRows

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class _Source:
    """A text with slices by the syntax tree's positions."""

    def __init__(self, text: str) -> None:
        self.data = text.encode("utf-8", "surrogatepass")
        self.starts = [0]
        for line in self.data.split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self._brackets: tuple[list[int], dict[int, int]] | None = None
        self.text = text

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)  # type: ignore[attr-defined]

    def cut(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.cut(*self.span(node))

    def brackets(self) -> tuple[list[int], dict[int, int]]:
        """Offsets of opening brackets, and where each one closes."""
        if self._brackets is None:
            lines = self.text.split("\n")
            close, stack = {}, []
            for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
                if t.type == tokenize.OP and t.string in "([{":
                    stack.append(self.at(t.start[0], len(lines[t.start[0] - 1][: t.start[1]].encode("utf-8", "surrogatepass"))))
                elif t.type == tokenize.OP and t.string in ")]}" and stack:
                    close[stack.pop()] = self.at(t.end[0], len(lines[t.end[0] - 1][: t.end[1]].encode("utf-8", "surrogatepass")))
            self._brackets = sorted(close), close
        return self._brackets


def parse_python(path: str, content: bytes, arguments: bool = False) -> FileRows:
    """The rows of a Python file; with ``arguments``, a call whose first argument is a string has it in ``extra`` as ``raw_target``."""
    rows = FileRows(path, "python")
    text = content.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    test = rows.base.startswith("test_") or rows.base.endswith("_test.py")
    try:
        tree, broken = ast.parse(text), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        tree, broken = None, {"parse_error": str(e) or type(e).__name__}
    key = rows.node("File", rows.base, 1, text.count("\n") + 1, test=test, extra=broken)
    if tree is not None:
        _Walk(rows, _Source(text), key, test, arguments).body(tree.body, key, "", "file")
    return rows


class _Walk:
    def __init__(self, rows: FileRows, source: _Source, file: str, test: bool, arguments: bool) -> None:
        self.rows, self.source, self.file, self.test, self.arguments = rows, source, file, test, arguments

    def body(self, statements: list[ast.stmt], owner: str, parent: str, within: str) -> None:
        for s in statements:
            if isinstance(s, ast.ClassDef):
                self.define_class(s, parent)
            elif isinstance(s, _DEFS):
                self.define_function(s, owner, parent, within)  # type: ignore[arg-type]
            elif isinstance(s, ast.Import):
                for a in s.names:
                    self.rows.edge("IMPORTS", owner, a.name, s.lineno, {"import_type": "module"})
            elif isinstance(s, ast.ImportFrom) and s.module != "__future__":
                module = "." * s.level + (s.module or "")
                for a in s.names:
                    self.rows.edge("IMPORTS", owner, module if a.name == "*" else f"{module}.{a.name}", s.lineno, {"import_type": "from", "module": module})
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
                self.call(s.value, owner)

    def modifiers(self, node: ast.ClassDef | ast.FunctionDef) -> str:
        return " ".join("@" + self.source.of(d).split("(")[0].strip() for d in node.decorator_list)

    def define_class(self, node: ast.ClassDef, parent: str) -> None:
        key = self.rows.node("Class", node.name, node.lineno, node.end_lineno or 0, parent=parent, modifiers=self.modifiers(node), test=self.test)
        self.rows.edge("CONTAINS", self.file, key, node.lineno)
        for base in node.bases:
            if isinstance(base, (ast.Name, ast.Attribute)):
                self.rows.edge("INHERITS", key, self.source.of(base), base.lineno)
        self.body(node.body, key, node.name, "class")

    def define_function(self, node: ast.FunctionDef, owner: str, parent: str, within: str) -> None:
        method = within == "class"
        symbol = f"{parent}.{node.name}" if method and parent else node.name
        returns = self.source.of(node.returns).strip() if node.returns else ""
        key = self.rows.node(
            "Method" if method else "Function", node.name, node.lineno, node.end_lineno or 0, symbol=symbol, parent=parent, params=self.parameters(node), returns=returns, modifiers=self.modifiers(node),
            test=self.test or node.name.startswith("test_"),
        )
        self.rows.edge("CONTAINS", owner, key, node.lineno)
        for call in sorted(_calls(node.body), key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset)):
            self.call(call, key)
        self.body(node.body, key, symbol, "function")

    def parameters(self, node: ast.FunctionDef) -> str:
        opens, close = self.source.brackets()
        at = bisect_left(opens, self.source.at(node.lineno, node.col_offset))
        while self.source.data[opens[at] : opens[at] + 1] == b"[":  # type parameters
            at = bisect_left(opens, close[opens[at]])
        return " ".join(self.source.cut(opens[at], close[opens[at]]).strip("()").split())

    def call(self, node: ast.Call, owner: str) -> None:
        (a, _), (b, c) = self.source.span(node), self.source.span(node.func)
        for _ in range(self.source.data[a:b].count(b"(")):  # a function in brackets
            c = self.source.data.index(b")", c) + 1
        name = self.source.cut(a, c)
        if name:
            first = node.args[0].value if self.arguments and node.args and isinstance(node.args[0], ast.Constant) else None
            self.rows.edge("CALLS", owner, name, node.lineno, {"raw_target": first} if isinstance(first, str) else None)


def _calls(body: list[ast.stmt]) -> Iterator[ast.Call]:
    """Calls of a function's body; of definitions in it only those in decorators."""
    rest: list[ast.AST] = list(body)
    while rest:
        node = rest.pop()
        if isinstance(node, _DEFS):
            rest += node.decorator_list
            continue
        if isinstance(node, ast.Call):
            yield node
        rest += ast.iter_child_nodes(node)
