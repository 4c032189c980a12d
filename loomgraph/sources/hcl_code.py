"""Terraform files: blocks and the references between them, from a small reader of the language's structure.

Attributes become numbers, booleans, strings, lists and maps; any other expression is kept as its source in ``${...}``, which is all that the
references need. Labels have no quotes. Lines are 0. A file that can't be read has its File node alone.
"""

from __future__ import annotations

import posixpath
import re
from typing import Any

from loomgraph.sources.rows import FileRows

_IDENT = re.compile(r"[^\W\d][\w\-]*")
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?\Z")
_HEREDOC = re.compile(r"<<(-?)([A-Za-z_][\w\-]*)[ \t]*\n")
_SKIP = re.compile(r"(?:[ \t\r\n]+|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_BLANK = re.compile(r"(?:[ \t\r]+|/\*.*?\*/)*", re.S)
#: Arguments of a module block that don't set a variable.
MODULE_ARGUMENTS = frozenset(("count", "depends_on", "for_each", "providers", "source", "version"))


class HclError(ValueError):
    """The text isn't HCL."""


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.i = text, 0

    def skip(self) -> None:
        self.i = _SKIP.match(self.text, self.i).end()  # type: ignore[union-attr]

    def string(self, i: int) -> int:
        """The end of the quoted string that begins at ``i``, interpolations and all."""
        i += 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 2
            elif c == '"':
                return i + 1
            elif self.text.startswith(("${", "%{"), i) and not self.text.startswith(("$${", "%%{"), i - 1):
                i = self.closing(i + 1)
            elif c == "\n":
                break
            else:
                i += 1
        raise HclError("unfinished string")

    def closing(self, i: int) -> int:
        """The end of the bracket that opens at ``i``."""
        depth = 0
        while i < len(self.text):
            c = self.text[i]
            if c == '"':
                i = self.string(i)
                continue
            if (h := _HEREDOC.match(self.text, i)) is not None:
                i = self.heredoc(h)
                continue
            if c == "#" or self.text.startswith("//", i):
                i = (self.text + "\n").index("\n", i)
                continue
            if self.text.startswith("/*", i):
                i = self.text.find("*/", i) + 2
                if i < 2:
                    break
                continue
            depth += (c in "([{") - (c in ")]}")
            i += 1
            if depth == 0:
                return i
        raise HclError("unfinished bracket")

    def heredoc(self, h: re.Match) -> int:
        end = re.compile(rf"^[ \t]*{re.escape(h[2])}[ \t\r]*$", re.M).search(self.text, h.end())
        if end is None:
            raise HclError("unfinished heredoc")
        return end.end()

    def expression(self, stop: str) -> str:
        """The source of an expression, up to a line end or one of ``stop`` outside brackets."""
        start = self.i
        while self.i < len(self.text):
            c = self.text[self.i]
            if c == '"':
                self.i = self.string(self.i)
            elif c in "([{":
                self.i = self.closing(self.i)
            elif (h := _HEREDOC.match(self.text, self.i)) is not None:
                self.i = self.heredoc(h)
            elif self.text.startswith("/*", self.i):
                self.i = _BLANK.match(self.text, self.i).end()  # type: ignore[union-attr]
            elif c in "\n#" or self.text.startswith("//", self.i) or c in stop:
                break
            elif c in ")]}":
                raise HclError("bracket without its partner")
            else:
                self.i += 1
        found = self.text[start : self.i].strip()
        if not found:
            raise HclError("expression expected")
        return found

    def body(self, nested: bool) -> dict[str, Any]:
        """Attributes, and lists of blocks."""
        out: dict[str, Any] = {}
        while True:
            self.skip()
            if self.i >= len(self.text) or self.text[self.i] == "}":
                if nested != (self.i < len(self.text)):
                    raise HclError("block end")
                self.i += nested
                return out
            name = _IDENT.match(self.text, self.i)
            if name is None:
                raise HclError("name expected")
            self.i = _BLANK.match(self.text, name.end()).end()  # type: ignore[union-attr]
            if self.text.startswith("=", self.i) and not self.text.startswith("==", self.i):
                self.i = _BLANK.match(self.text, self.i + 1).end()  # type: ignore[union-attr]
                out[name[0]] = value(self.expression("}"))
                continue
            labels = []
            while not self.text.startswith("{", self.i):
                if self.text.startswith('"', self.i):
                    end = self.string(self.i)
                    labels.append(self.text[self.i + 1 : end - 1])
                elif (word := _IDENT.match(self.text, self.i)) is not None:
                    end = word.end()
                    labels.append(word[0])
                else:
                    raise HclError("label or block expected")
                self.i = _BLANK.match(self.text, end).end()  # type: ignore[union-attr]
            self.i += 1
            block: Any = self.body(True)
            for label in reversed(labels):
                block = {label: block}
            before = out.setdefault(name[0], [])
            if not isinstance(before, list):
                raise HclError("block and attribute of one name")
            before.append(block)

    def items(self, mapping: bool) -> Any:
        """The elements of a list or map literal of which the text is the inside."""
        keys, values = [], []
        while True:
            self.skip()
            if self.text.startswith(",", self.i):
                self.i += 1
                continue
            if self.i >= len(self.text):
                return dict(zip(keys, values)) if mapping else values
            if mapping:
                key = self.expression("=:")
                keys.append(key[1:-1] if key.startswith('"') else key)
                self.i += 1
                self.i = _BLANK.match(self.text, self.i).end()  # type: ignore[union-attr]
                values.append(value(self.expression(",")))
            else:
                values.append(value(self.element()))

    def element(self) -> str:
        """An element of a list; line ends don't end it."""
        start = self.i
        while self.i < len(self.text) and self.text[self.i] != ",":
            if self.text[self.i] == "\n" or self.text[self.i] == "#":
                self.skip()
                continue
            try:
                self.expression(",")
            except HclError:
                self.i += 1
        return self.text[start : self.i].strip()


def value(text: str) -> Any:
    """An expression's source as a value."""
    if _NUMBER.match(text):
        return float(text) if any(c in text for c in ".eE") else int(text)
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    reader = _Reader(text)
    if text[0] == '"' and reader.string(0) == len(text):
        return text[1:-1]
    if (h := _HEREDOC.match(text)) is not None:
        return text[h.end() :].rsplit("\n", 1)[0] if reader.heredoc(h) == len(text) else "${" + text + "}"
    if text[0] in "[{" and reader.closing(0) == len(text) and not re.match(r"[\[{]\s*for\b", text):
        return _Reader(text[1:-1]).items(text[0] == "{")
    return "${" + text + "}"


def read_hcl(text: str) -> dict[str, Any]:
    """The attributes and blocks of a file."""
    return _Reader(text).body(False)


def parse_hcl(path: str, content: bytes) -> FileRows:
    """The rows of a Terraform file. A number, boolean or null as a file's own value (``.tfvars``) is an error, as such a value holds no blocks."""
    rows = FileRows(path, "hcl")
    file = rows.node("File", rows.base)
    try:
        blocks = read_hcl(content.decode("utf-8").removeprefix("﻿"))
    except (UnicodeDecodeError, HclError, IndexError, RecursionError):
        return rows
    for name, items in blocks.items():
        if not isinstance(items, (str, list, dict)):
            raise TypeError(f"{name}: a {type(items).__name__} where blocks were expected")
    for name, items in blocks.items():
        if name in _BLOCKS and isinstance(items, list):
            for item in items:
                if isinstance(item, dict):
                    _BLOCKS[name](rows, item)
    for n in rows.nodes[1:]:
        rows.edge("CONTAINS", file, n["qualified_name"])
    _references(rows, file, blocks)
    return rows


def _typed(kind: str, field: str):  # type: ignore[no-untyped-def]
    def add(rows: FileRows, item: dict) -> None:
        for first, instances in item.items():
            for second in instances if isinstance(instances, dict) else ():
                rows.node(kind, f"{first}.{second}", extra={"provider": first.split("_")[0], field: first})

    return add


def _named(kind: str, fields: str):  # type: ignore[no-untyped-def]
    def add(rows: FileRows, item: dict) -> None:
        for name, body in item.items():
            body = body if isinstance(body, dict) else {}
            rows.node(kind, name, extra={f: str(body.get(f, "")) for f in fields.split()})

    return add


def _module(rows: FileRows, item: dict) -> None:
    for name, body in item.items():
        body = body if isinstance(body, dict) else {}
        source = body.get("source", "")
        key = rows.node("Module", name, extra={"source": source})
        if isinstance(source, str) and source.startswith(("./", "../")):
            folder = posixpath.dirname(rows.path)
            parts = [p for p in source.split("/") if p not in ("", ".")]
            main = "/".join([folder, *parts, "main.tf"])
            rows.edge("USES_MODULE", key, source, extra={"source_path": source}, probe=posixpath.normpath(main), found=main)
        for argument, given in body.items():
            if argument not in MODULE_ARGUMENTS:
                rows.edge("PASSES_VAR", key, f"{rows.path}::{argument}", extra={"var_name": argument, "value": str(given)})


def _locals(rows: FileRows, item: dict) -> None:
    for name, given in item.items():
        rows.node("Local", name, extra={"value": str(given)})


_BLOCKS = {
    "resource": _typed("Resource", "resource_type"), "data": _typed("DataSource", "data_type"), "module": _module, "variable": _named("Variable", "type default description"),
    "output": _named("Output", "description value"), "provider": _named("Provider", "region alias"), "locals": _locals,
    "terraform": lambda rows, item: rows.node("TerraformConfig", "terraform", extra=item),
}

#: What a text may refer to, in the order in which it is looked for.
REFERENCES = [
    ("Variable", re.compile(r"\bvar\.([\w\-]+)", re.A)), ("Local", re.compile(r"\blocal\.([\w\-]+)", re.A)), ("Module", re.compile(r"\bmodule\.([\w\-]+)", re.A)),
    ("DataSource", re.compile(r"\bdata\.([\w\-]+\.[\w\-]+)", re.A)), ("Resource", re.compile(r"\b(?!(?:var|local|module|data)\.)([a-z][A-Za-z0-9_]*\.[\w\-]+)\.[\w\-]+", re.A)),
]


def _references(rows: FileRows, file: str, blocks: dict) -> None:
    """REFERENCES between blocks of this file; what isn't in a resource, data source, module or output comes from the file."""
    known = {(n["kind"], n["name"]): n["qualified_name"] for n in rows.nodes[1:]}
    seen: set[tuple[str, str]] = set()

    def scan(given: Any, source: str) -> None:
        if isinstance(given, dict):
            given = list(given.values())
        if isinstance(given, list):
            for x in given:
                scan(x, source)
        elif isinstance(given, str):
            for kind, pattern in REFERENCES:
                for m in pattern.finditer(given):
                    target = known.get((kind, m[1]))
                    if target and (source, target) not in seen:
                        seen.add((source, target))
                        rows.edge("REFERENCES", source, target)

    for name, items in blocks.items():
        for item in items if isinstance(items, list) else ():
            if not isinstance(item, dict):
                continue
            if name in ("resource", "data"):
                for first, instances in item.items():
                    for second, body in instances.items() if isinstance(instances, dict) else ():
                        scan(body, known.get(("Resource" if name == "resource" else "DataSource", f"{first}.{second}"), file))
            elif name in ("module", "output"):
                for label, body in item.items():
                    scan(body, known.get((name.capitalize(), label), file))
            elif name in ("locals", "variable", "provider", "terraform"):
                scan(item, file)
