"""Jinja2 templates: inheritance, includes, blocks, macros and the variables each of them uses, from a scanner of tags and expressions.

Every name in an expression counts as a variable: loop and set targets, parameters of macros and called names too; attributes, filters,
tests and names of keyword arguments don't. Names of a nested block or macro belong to it alone. A template with a
syntax error has its File node alone, with ``parse_error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from loomgraph.sources.rows import FileRows

_OPEN = re.compile(r"\{#|\{%|\{\{")
_RAW = re.compile(r"\{%[-+]?\s*raw\s*-?%\}(.*?)\{%[-+]?\s*endraw\s*[-+]?%\}", re.S)
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?))"
    r"|(?P<name>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|\*\*|//|[-+*/%~\[\](){}<>=.:|,;])",
    re.S,
)
_WORDS = frozenset("and else false if in is none not or true False None True".split())
#: Tags that open a part, with the tags that may go on in it.
_PARTS = {"block": (), "macro": (), "for": ("else",), "if": ("elif", "else"), "call": (), "filter": (), "with": (), "autoescape": (), "set": ()}


class TemplateError(ValueError):
    """The text isn't a template."""


@dataclass
class Token:
    """A token of an expression."""

    kind: str
    text: str
    line: int


@dataclass
class Part:
    """A tag with what it holds, in order: names and calls as (what, name, line), and further parts."""

    tag: str
    line: int
    name: str = ""
    params: str = ""
    items: list = field(default_factory=list)
    last: int = 0

    def walk(self) -> Iterator[Part]:
        for x in self.items:
            if isinstance(x, Part):
                yield x
                yield from x.walk()

    def scope(self) -> Iterator[tuple[str, str, int]]:
        """Names and calls without those of nested blocks and macros."""
        for x in self.items:
            if not isinstance(x, Part):
                yield x
            elif x.tag not in ("block", "macro"):
                yield from x.scope()

    def end(self) -> int:
        return max([self.line, self.last, *(x.end() if isinstance(x, Part) else x[2] for x in self.items)])


def tokens(text: str, line: int) -> list[Token]:
    """The tokens of an expression, brackets checked."""
    out, i, stack = [], 0, []
    while i < len(text):
        m = _TOKEN.match(text, i)
        if m is None:
            raise TemplateError(f"unexpected char {text[i]!r} at line {line}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup or "", m[0], line))
            if m[0] in ("(", "[", "{"):
                stack.append({"(": ")", "[": "]", "{": "}"}[m[0]])
            elif m[0] in (")", "]", "}") and (not stack or stack.pop() != m[0]):
                raise TemplateError(f"unexpected {m[0]!r} at line {line}")
        line += m[0].count("\n")
        i = m.end()
    if stack:
        raise TemplateError(f"missing {stack[-1]!r} at line {line}")
    return out


def names(found: list[Token]) -> list[tuple[str, str, int]]:
    """('name' or 'call', name, line) of the variables and direct calls in tokens."""
    out, brackets = [], []
    for i, t in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        if t.text in ("(", "[", "{") and t.kind == "op":
            brackets.append(t.text == "(" and before is not None and (before.kind == "name" and before.text not in _WORDS or before.text in (")", "]")))
        elif t.text in (")", "]", "}") and t.kind == "op" and brackets:
            brackets.pop()
        if t.kind != "name" or t.text in _WORDS:
            continue
        if before is not None and (before.text in (".", "|") and before.kind == "op" or before.text == "is" or before.text == "not" and i > 1 and found[i - 2].text == "is"):
            continue
        if after is not None and after.text == "=" and brackets and brackets[-1]:
            continue
        out.append(("name", t.text, t.line))
        if after is not None and after.text == "(":
            out.append(("call", t.text, after.line))
    return out


def _reference(found: list[Token]) -> str:
    """The template that an expression names."""
    if found and all(t.kind == "string" for t in found):
        return "".join(re.sub(r"\\(.)", r"\1", t.text[1:-1]) for t in found)
    return found[0].text if len(found) == 1 and found[0].kind == "number" else "<dynamic>"


def _close(text: str, i: int, end: str) -> int:
    """Where the tag's ``end`` is, strings and brackets aside."""
    depth = 0
    while i < len(text):
        if text[i] in "'\"":
            m = _TOKEN.match(text, i)
            if m is None:
                raise TemplateError("unfinished string")
            i = m.end()
            continue
        if not depth and text.startswith(end, i):
            return i
        depth += (text[i] in "([{") - (text[i] in ")]}")
        i += 1
    raise TemplateError(f"missing {end!r}")


def read_template(text: str) -> Part:
    """The parts of a template."""
    text = re.sub(r"\r\n|\r", "\n", text)
    text = text.removesuffix("\n")
    root = Part("template", 1)
    stack, i, line = [root], 0, 1

    def data(chunk: str, at: int) -> None:
        if chunk:
            stack[-1].last = max(stack[-1].last, at)

    while (m := _OPEN.search(text, i)) is not None:
        data(text[i : m.start()], line)
        line += text.count("\n", i, m.start())
        if m[0] == "{#":
            end = text.find("#}", m.end())
            if end < 0:
                raise TemplateError("Missing end of comment tag")
            end += 2
        elif (raw := _RAW.match(text, m.start())) is not None:
            data(raw[1], line)
            end = raw.end()
        else:
            close = "%}" if m[0] == "{%" else "}}"
            end = _close(text, m.end(), close)
            inside, start = text[m.end() : end], line
            if inside[:1] in ("-", "+"):
                inside = inside[1:]
            inside = inside.removesuffix("-").removesuffix("+") if inside[-1:] in ("-", "+") else inside
            end += 2
            found = tokens(inside, start)
            if m[0] == "{{":
                if not found:
                    raise TemplateError(f"Expected an expression at line {start}")
                stack[-1].items += names(found)
                stack[-1].last = max(stack[-1].last, start)
            else:
                _tag(found, stack, start)
        line += text.count("\n", m.start(), end)
        i = end
    data(text[i:], line)
    if len(stack) > 1:
        raise TemplateError(f"Unexpected end of template: {stack[-1].tag!r} at line {stack[-1].line} isn't closed")
    return root


def _tag(found: list[Token], stack: list[Part], line: int) -> None:
    if not found or found[0].kind != "name":
        raise TemplateError(f"tag name expected at line {line}")
    tag, rest, top = found[0].text, found[1:], stack[-1]
    if tag.startswith("end"):
        if len(stack) == 1 or top.tag != tag[3:]:
            raise TemplateError(f"Encountered unknown tag {tag!r} at line {line}")
        stack.pop()
    elif tag in ("else", "elif") and tag in _PARTS.get(top.tag, ()):
        top.items += names(rest)
        top.last = max(top.last, line)
    elif tag in ("extends", "include", "import", "from"):
        cut = next((k for k, t in enumerate(rest) if t.kind == "name" and t.text in {"include": ("ignore", "with", "without"), "import": ("as", "with"), "from": ("import",)}.get(tag, ())), len(rest))
        if not cut:
            raise TemplateError(f"Expected an expression at line {line}")
        top.items.append(Part(tag, line, name=_reference(rest[:cut]), items=names(rest[:cut])))
    elif tag == "print":
        top.items += names(rest)
        top.last = max(top.last, line)
    elif tag == "set" and any(t.text == "=" for t in rest):
        cut = next(k for k, t in enumerate(rest) if t.text == "=")
        space = any(t.text == "." for t in rest[:cut])  # an attribute of a namespace is no variable
        top.items.append(Part("assign", line, items=([] if space else names(rest[:cut])) + names(rest[cut + 1 :])))
    elif tag in _PARTS:
        part = Part(tag, line)
        if tag in ("block", "macro"):
            if not rest or rest[0].kind != "name":
                raise TemplateError(f"name expected at line {line}")
            part.name, rest = rest[0].text, rest[1:]
        if tag == "block":
            rest = []
        elif tag == "macro":
            part.params = ", ".join(_parameters(rest))
            rest = [Token("op", ",", line) if t.text == "=" else t for t in rest]  # a parameter is a name, its default an expression
        elif tag == "filter":
            rest = [Token("op", "|", line), *rest]
        elif tag == "for" and not any(t.text == "in" for t in rest):
            raise TemplateError(f"expected token 'in' at line {line}")
        elif tag == "for" and rest and rest[-1].text == "recursive":
            rest = rest[:-1]
        elif tag in ("with", "call"):
            rest = [Token("op", ",", line) if t.text == "=" and tag == "with" else t for t in rest]
        part.items += names(rest)
        top.items.append(part)
        stack.append(part)
    else:
        raise TemplateError(f"Encountered unknown tag {tag!r} at line {line}")


def _parameters(rest: list[Token]) -> Iterator[str]:
    depth, fresh = 0, True
    for t in rest:
        if depth == 1 and fresh and t.kind == "name":
            yield t.text
            fresh = False
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}")) if t.kind == "op" else 0
        if depth == 1 and t.text in ("(", ","):
            fresh = True
        elif depth == 1 and t.text == "=":
            fresh = False


def parse_jinja(path: str, content: bytes) -> FileRows:
    """The rows of a template."""
    rows = FileRows(path, "jinja2")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    last = text.count("\n") + 1
    try:
        root, broken = read_template(text), None
    except (TemplateError, RecursionError) as e:
        root, broken = None, {"parse_error": str(e)}
    file = rows.node("File", rows.base, 1, last, extra=broken)
    if root is None:
        return rows
    template = rows.node("Template", "template", 1, last)
    rows.edge("CONTAINS", file, template, 1)
    parts = list(root.walk())
    macros = {p.name for p in parts if p.tag == "macro"}
    for tag, kind, link, mine, theirs in (("extends", "Extends", "EXTENDS", "parent", "parent_template"), ("include", "Include", "INCLUDES", "included", "included_template")):
        for p in parts:
            if p.tag == tag:
                key = rows.node(kind, f"{tag}:{p.name}", p.line, p.line, extra={mine: p.name})
                rows.edge(link, template, key, p.line, {theirs: p.name})
    for tag in ("block", "macro"):
        for p in parts:
            if p.tag == tag:
                key = rows.node(tag.capitalize(), p.name, p.line, p.end(), symbol=f"{tag}:{p.name}", parent="template", params=p.params)
                rows.edge("CONTAINS", template, key, p.line)
                _uses(rows, p, key, p.name, macros)
    _uses(rows, root, template, "template", macros)
    return rows


def _uses(rows: FileRows, part: Part, owner: str, scope: str, macros: set[str]) -> None:
    """The variables of a scope, each at its first use, then its calls of macros of this file."""
    first: dict[str, int] = {}
    held = list(part.scope())
    for what, name, line in held:
        if what == "name":
            first.setdefault(name, line)
    for name, line in first.items():
        key = rows.node("Variable", name, line, line, symbol=f"var:{scope}:{name}", parent=scope)
        rows.edge("USES_VARIABLE", owner, key, line, {"variable": name})
    for what, name, line in held:
        if what == "call" and name in macros:
            rows.edge("CALLS_MACRO", owner, f"{rows.path}::macro:{name}", line, {"macro": name})
