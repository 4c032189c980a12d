"""YAML files: documents, anchors, sections, and Kubernetes manifests with what they refer to.

Scalars follow YAML 1.2: only true and false are booleans. Of a repeated key the first counts. Keys merged by ``<<`` come after a
mapping's own. An edge is made for each alias of a mapping or sequence, none for the anchor itself nor for scalars. Templates and
other texts that can't be parsed have their File node alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import yaml

from loomgraph.sources.rows import FileRows

_INT = re.compile(r"[-+]?\d[\d_]*\Z|0o[0-7_]+\Z|0x[0-9a-fA-F_]+\Z")
_FLOAT = re.compile(r"[-+]?(\.\d+|\d[\d_]*(\.\d*)?)([eE][-+]?\d+)?\Z|[-+]?\.(inf|Inf|INF)\Z|\.(nan|NaN|NAN)\Z")
_DATE = re.compile(r"\d{4}-\d\d-\d\d\Z")
_TIME = re.compile(r"\d{4}-\d\d?-\d\d?([Tt]|[ \t]+)\d\d?:\d\d:\d\d")
_STYLES = {'"': "DoubleQuotedScalarString", "'": "SingleQuotedScalarString", "|": "LiteralScalarString", ">": "FoldedScalarString"}
_VALUES_FILES = frozenset(f"{name}.{end}" for name in ("chart", "values") for end in ("yml", "yaml"))
#: Keys of which three or more at the top make a file one of chart values.
VALUES_KEYS = frozenset(
    "affinity autoscaling image ingress livenessProbe nodeSelector podAnnotations podSecurityContext readinessProbe replicaCount resources securityContext service serviceAccount tolerations".split()
)
#: Longest scalar and annotation that is stored.
MOST = 200


class _Alias(yaml.Node):
    def __init__(self, node: yaml.Node, anchor: str) -> None:
        super().__init__(node.tag, node.value, node.start_mark, node.end_mark)
        self.node, self.anchor = node, anchor


class _Loader(yaml.SafeLoader):
    """Composes nodes that remember anchors, with aliases as nodes of their own."""

    def compose_node(self, parent, index):  # type: ignore[no-untyped-def]
        event = self.peek_event()
        if isinstance(event, yaml.AliasEvent):
            return _Alias(super().compose_node(parent, index), event.anchor)
        self.anchors.pop(event.anchor, None)
        node = super().compose_node(parent, index)
        node.anchor = event.anchor
        return node

    def flatten_mapping(self, node):  # type: ignore[no-untyped-def]
        raise NotImplementedError


def _plain(node: yaml.Node) -> yaml.Node:
    return node.node if isinstance(node, _Alias) else node


def scalar(node: yaml.ScalarNode) -> Any:
    """The value of a scalar."""
    text = node.value
    if node.style or not node.tag.startswith("tag:yaml.org,2002:"):
        return text
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if _INT.match(text):
        bare = text.replace("_", "")
        return int(bare, 0) if bare[:2] in ("0o", "0x") else int(bare)
    if _FLOAT.match(text):
        bare = text.replace("_", "").lower()
        return float(bare.replace(".inf", "inf").replace(".nan", "nan"))
    return text


def type_name(node: yaml.Node) -> str:
    """The name under which a value's type is stored."""
    if isinstance(node, yaml.MappingNode):
        return "mapping"
    if isinstance(node, yaml.SequenceNode):
        return "sequence"
    held, marked = scalar(node), getattr(node, "anchor", None)
    if isinstance(held, bool):
        return "ScalarBoolean" if marked else "bool"
    if held is None:
        return "NoneType"
    if isinstance(held, float):
        return "ScalarFloat"
    if isinstance(held, int):
        return "HexInt" if node.value[:2] == "0x" else "OctalInt" if node.value[:2] == "0o" else "ScalarInt" if marked or "_" in node.value else "int"
    if node.style in _STYLES:
        return _STYLES[node.style]
    return "date" if _DATE.match(held) else "TimeStamp" if _TIME.match(held) else "PlainScalarString" if marked else "str"


class Map:
    """A mapping's pairs: own keys in order, the first of equals, then merged ones. Keys are texts; ``line`` has the lines of string keys."""

    def __init__(self, node: yaml.MappingNode) -> None:
        self.node, self.values, self.line = node, {}, {}
        merged = []
        for key, value in node.value:
            if isinstance(_plain(key), yaml.ScalarNode) and key.value == "<<" and not getattr(key, "style", None):
                target = _plain(value)
                merged += [_plain(x) for x in target.value] if isinstance(target, yaml.SequenceNode) else [target]
                continue
            held = scalar(_plain(key)) if isinstance(_plain(key), yaml.ScalarNode) else yaml.serialize(_plain(key)).strip()
            if str(held) not in self.values:
                self.values[str(held)] = value
                if isinstance(held, str):
                    self.line[held] = key.start_mark.line + 1
        for other in merged:
            if isinstance(other, yaml.MappingNode):
                for key, value in Map(other).values.items():
                    self.values.setdefault(key, value)

    def key_line(self, key: str) -> int:
        return self.line.get(key, self.node.start_mark.line + 1)

    def child(self, *path: str) -> Any:
        """The value at a path of keys: a Map, a list of nodes, a scalar's value or None."""
        at: Any = self
        for key in path:
            at = content(at.values[key]) if isinstance(at, Map) and key in at.values else None
        return at


def content(node: yaml.Node) -> Any:
    """A node's Map, list of nodes or scalar value."""
    node = _plain(node)
    return Map(node) if isinstance(node, yaml.MappingNode) else node.value if isinstance(node, yaml.SequenceNode) else scalar(node)


def _maps(value: Any) -> Iterator[Map]:
    for x in value if isinstance(value, list) else ():
        if isinstance(found := content(x), Map):
            yield found


def data(node: yaml.Node) -> Any:
    """A node as plain values."""
    found = content(node)
    return {k: data(v) for k, v in found.values.items()} if isinstance(found, Map) else [data(x) for x in found] if isinstance(found, list) else found


def manifest_references(doc: Map) -> list[tuple[str, str]]:
    """(kind, name) of config maps, secrets and services that a manifest names."""
    out: list[tuple[str, str]] = []

    def named(at: Map, *path: str, kind: str) -> None:
        if isinstance(at.child(*path[:-1]), Map) and path[-1] in at.child(*path[:-1]).values:
            out.append((kind, str(at.child(*path))))

    pod = doc.child("spec", "template", "spec")
    if isinstance(pod, Map):
        for volume in _maps(pod.child("volumes")):
            named(volume, "configMap", "name", kind="ConfigMap")
            named(volume, "secret", "secretName", kind="Secret")
        for group in ("containers", "initContainers"):
            for container in _maps(pod.child(group)):
                for source in _maps(container.child("envFrom")):
                    named(source, "configMapRef", "name", kind="ConfigMap")
                    named(source, "secretRef", "name", kind="Secret")
    service = doc.child("spec", "serviceName")
    if service:
        out.append(("Service", str(service)))
    return out


def parse_yaml(path: str, source: bytes) -> FileRows:
    """The rows of a YAML file."""
    rows = FileRows(path, "yaml")
    text = source.decode("utf-8", "replace")
    last = text.count("\n") + 1
    file = rows.node("File", rows.base, 1, last)
    try:
        docs = [d for d in yaml.compose_all(text, _Loader) if d is not None and content(d) is not None]
    except (yaml.YAMLError, ValueError, RecursionError, AttributeError):
        return rows
    if not docs:
        return rows
    top = content(docs[0])
    keys = set(top.values) if isinstance(top, Map) else set()
    helm = rows.base.lower() in _VALUES_FILES or len(keys & VALUES_KEYS) >= 3 or ({"apiVersion", "name", "version"} <= keys and "kind" not in keys)
    for i, doc in enumerate(docs):
        _document(rows, doc, f"doc{i}" if len(docs) > 1 else "", i, file, last, helm)
    return rows


def _document(rows: FileRows, node: yaml.Node, name: str, number: int, file: str, last: int, helm: bool) -> None:
    line = 1 if isinstance(node, yaml.ScalarNode) else node.start_mark.line + 1
    owner, owner_name = file, rows.base
    if name:
        owner, owner_name = rows.node("Document", name, line, last, parent=rows.base, extra={"doc_index": number}), name
        rows.edge("CONTAINS", file, owner, line)
    if not isinstance(node, yaml.MappingNode):
        return
    anchors: dict[str, tuple[str, int]] = {}
    _anchors(node, anchors, set())
    keys = {}
    for anchor, (kind, at) in anchors.items():
        keys[anchor] = rows.node("Anchor", f"&{anchor}", at or line, at or line, parent=owner_name, extra={"anchor_name": anchor, "value_type": kind})
        rows.edge("CONTAINS", owner, keys[anchor], at or line)
    doc = Map(node)
    if "apiVersion" in doc.values and "kind" in doc.values:
        _manifest(rows, doc, line, owner, owner_name)
    else:
        for key, value in doc.values.items():
            at, found, section = doc.key_line(key), content(value), f"{name}.{key}" if name else key
            extra: dict[str, Any] = {"key": key} | ({"helm": True} if helm else {}) | {"value_type": type_name(_plain(value))}
            if isinstance(found, Map):
                extra["child_keys"] = list(found.values)
            elif isinstance(found, list):
                extra["length"] = len(found)
            elif found is not None and len(str(found)) <= MOST:
                extra["value"] = str(found)
            rows.edge("CONTAINS", owner, rows.node("Section", section, at, at, parent=owner_name, extra=extra), at)
    _aliases(rows, node, owner, keys, 0)


def _manifest(rows: FileRows, doc: Map, line: int, owner: str, owner_name: str) -> None:
    kind, name, space = str(doc.child("kind")), doc.child("metadata", "name"), doc.child("metadata", "namespace")
    label = f"{kind}/{name}" if name and not isinstance(name, (Map, list)) else kind
    extra: dict[str, Any] = {"apiVersion": str(doc.child("apiVersion")), "k8s_kind": kind}
    if space:
        extra["namespace"] = str(space)
    labels, notes = doc.child("metadata", "labels"), doc.child("metadata", "annotations")
    if isinstance(labels, Map):
        extra["labels"] = {k: data(v) for k, v in labels.values.items()}
    if isinstance(notes, Map) and (short := {k: data(v) for k, v in notes.values.items() if len(str(data(v))) <= MOST}):
        extra["annotations"] = short
    resource = rows.node("K8sResource", label, line, line, parent=owner_name, extra=extra)
    rows.edge("CONTAINS", owner, resource, line)
    for key in doc.values:
        if key not in ("apiVersion", "kind"):
            at = doc.key_line(key)
            rows.edge("CONTAINS", resource, rows.node("Section", f"{label}.{key}", at, at, parent=label, extra={"key": key, "k8s_section": True}), at)
    for ref_kind, ref in manifest_references(doc):
        rows.edge("REFERENCES", resource, f"k8s::{ref_kind}/{ref}", line, {"ref_kind": ref_kind, "ref_name": ref, "unresolved": True})


def _children(node: yaml.Node) -> Iterator[tuple[yaml.Node, int]]:
    if isinstance(node, yaml.MappingNode):
        held = Map(node)
        for key, value in held.values.items():
            yield value, held.key_line(key)
    elif isinstance(node, yaml.SequenceNode):
        for value in node.value:
            yield value, _plain(value).start_mark.line + 1


def _anchors(node: yaml.Node, found: dict[str, tuple[str, int]], seen: set[int]) -> None:
    node = _plain(node)
    if id(node) in seen:
        return
    seen.add(id(node))
    anchor = getattr(node, "anchor", None)
    if anchor and not (isinstance(node, yaml.ScalarNode) and scalar(node) is None):
        found[anchor] = (type_name(node), 0 if isinstance(node, yaml.ScalarNode) else node.start_mark.line + 1)
    for child, _ in _children(node):
        _anchors(child, found, seen)


def _aliases(rows: FileRows, node: yaml.Node, owner: str, keys: dict[str, str], line: int) -> None:
    if isinstance(node, _Alias):
        if node.anchor in keys and not isinstance(node.node, yaml.ScalarNode):
            rows.edge("REFERENCES", owner, keys[node.anchor], line, {"via": "alias", "anchor": node.anchor})
        return
    for child, at in _children(node):
        _aliases(rows, child, owner, keys, at)
