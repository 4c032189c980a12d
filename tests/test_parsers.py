"""Rows of each language's parser for small files."""

import json

import pytest
from loomgraph.sources.hcl_code import HclError, parse_hcl, read_hcl
from loomgraph.sources.jinja_code import parse_jinja
from loomgraph.sources.python_code import parse_python
from loomgraph.sources.registry import detect_language, extension, parse_file
from loomgraph.sources.yaml_code import parse_yaml


def nodes(rows, *fields):
    return [tuple(n[f] for f in ("kind", "name", *fields)) for n in rows.nodes]


def edges(rows, kind=None):
    short = lambda k: k.removeprefix(rows.path)
    return [(e["kind"], short(e["source_qualified"]), short(e["target_qualified"]), e["line"]) for e in rows.edges if kind in (None, e["kind"])]


SVC = b'''import os
from yaml import safe_load

class Base:
    pass

class Svc(Base):
    @staticmethod
    def load(path: str) -> dict:
        return safe_load(open(path))

def run():
    print("x")
'''


def test_python_rows():
    rows = parse_python("/r/app/svc.py", SVC)
    assert nodes(rows, "line_start", "line_end") == [("File", "svc.py", 1, 14), ("Class", "Base", 4, 5), ("Class", "Svc", 7, 10), ("Method", "load", 9, 10), ("Function", "run", 12, 13)]
    load = rows.nodes[3]
    assert (load["qualified_name"], load["params"], load["return_type"], load["modifiers"], load["parent_name"]) == ("/r/app/svc.py::Svc.load", "path: str", "dict", "@staticmethod", "Svc")
    assert edges(rows) == [
        ("IMPORTS", "", "os", 1), ("IMPORTS", "", "yaml.safe_load", 2), ("CONTAINS", "", "::Base", 4), ("CONTAINS", "", "::Svc", 7), ("INHERITS", "::Svc", "Base", 7), ("CONTAINS", "::Svc", "::Svc.load", 9),
        ("CALLS", "::Svc.load", "safe_load", 10), ("CALLS", "::Svc.load", "open", 10), ("CONTAINS", "", "::run", 12), ("CALLS", "::run", "print", 13), ("CALLS", "::run", "print", 13),
    ]


def test_python_details():
    rows = parse_python(
        "/r/test_a.py",
        b'''from __future__ import annotations
from . import x
from .a import b as c, d
from m import *
import p.q as r
if True:
    import hidden
y = f()
g(h(1))
class Outer(a.B, metaclass=M):
    class Inner(list):
        async def go(self, a=(1, 2), *,
                     b: int = k()) -> "list[int]": return a(b).c(lambda: z())
def outer():
    """text"""
    @deco(arg())
    def inner(): lost()
    return inner
''',
    )
    assert [e[2] for e in edges(rows, "IMPORTS")] == ["..x", ".a.b", ".a.d", "m", "p.q"]
    assert [e[1:3] for e in edges(rows, "CALLS")] == [("", "g"), ("::Inner.go", "a(b).c"), ("::Inner.go", "a"), ("::Inner.go", "z"), ("::outer", "deco"), ("::outer", "arg"), ("::inner", "lost"), ("::inner", "lost")]
    assert [e[1:3] for e in edges(rows, "INHERITS")] == [("::Outer", "a.B"), ("::Inner", "list")]
    go = next(n for n in rows.nodes if n["name"] == "go")
    assert (go["params"], go["return_type"], go["modifiers"], go["is_test"]) == ("self, a=(1, 2), *, b: int = k", '"list[int]"', "", True)
    assert next(n for n in rows.nodes if n["name"] == "inner")["modifiers"] == "@deco"


@pytest.mark.parametrize("content", [b"def broken(:\n", b"\xff\xfe", b"x = 1\n" * 5 + b"\x00"])
def test_python_broken_file_has_its_file_node(content):
    rows = parse_python("/r/b.py", content)
    assert nodes(rows) == [("File", "b.py")] and not rows.edges and "parse_error" in rows.nodes[0]["extra"]


def test_python_empty():
    assert nodes(parse_python("/r/e.py", b""), "line_end") == [("File", "e.py", 1)]


MAIN = b'''variable "region" { default = "eu" }
locals { cfg = yamldecode(file("app.yaml")) }
resource "aws_vpc" "main" { cidr = var.region }
data "terraform_remote_state" "legacy" { backend = "s3" }
module "users" {
  source   = "./users"
  policies = data.terraform_remote_state.legacy.outputs.policy_arn
}
output "vpc_id" { value = aws_vpc.main.id }
'''


def test_hcl_rows():
    rows = parse_hcl("/r/a/main.tf", MAIN)
    assert nodes(rows, "line_start") == [("File", "main.tf", 0), ("Variable", "region", 0), ("Local", "cfg", 0), ("Resource", "aws_vpc.main", 0), ("DataSource", "terraform_remote_state.legacy", 0), ("Module", "users", 0), ("Output", "vpc_id", 0)]
    assert edges(rows, "USES_MODULE") == [("USES_MODULE", "::users", "./users", 0)] and rows.edges[0]["probe"] == "/r/a/users/main.tf"
    assert edges(rows, "PASSES_VAR") == [("PASSES_VAR", "::users", "::policies", 0)]
    assert [e[1:3] for e in edges(rows, "REFERENCES")] == [("::aws_vpc.main", "::region"), ("::users", "::terraform_remote_state.legacy"), ("::vpc_id", "::aws_vpc.main")]
    assert len(edges(rows, "CONTAINS")) == 6


def test_hcl_values():
    held = read_hcl(
        '''# comment
a = 1
b = [1, "x", true, var.y] // more
c = { k = "v", "q r" : null
  n = { z = 2.5 } }
d = <<-EOT
  hello ${var.name}
  EOT
e = "pre-${lookup(var.m, "k}")}-post"
f = [for x in var.l : upper(x)]
g = foo(
  1,
  2
)
h = a ? "b" : "c"
block "one" "two" {
  /* long
     comment */
  inner { v = 1 }
  inner { v = 2 }
}
block "one" "three" {}
'''
    )
    assert held["a"] == 1 and held["b"] == [1, "x", True, "${var.y}"] and held["c"] == {"k": "v", "q r": None, "n": {"z": 2.5}}
    assert held["d"].strip() == "hello ${var.name}" and held["e"] == 'pre-${lookup(var.m, "k}")}-post'
    assert held["f"] == "${[for x in var.l : upper(x)]}" and held["g"].startswith("${foo(") and held["h"] == '${a ? "b" : "c"}'
    assert held["block"] == [{"one": {"two": {"inner": [{"v": 1}, {"v": 2}]}}}, {"one": {"three": {}}}]
    for broken in ('a = "x', "b {", "}", "x = ", "= 1"):
        with pytest.raises(HclError):
            read_hcl(broken)


def test_hcl_special_files():
    assert nodes(parse_hcl("/r/x.tf", b"resource {{{")) == [("File", "x.tf")]
    assert nodes(parse_hcl("/r/x.tfvars", b'region = "eu"\n')) == [("File", "x.tfvars")]
    with pytest.raises(TypeError):
        parse_hcl("/r/x.tfvars", b"count = 3\n")
    same = parse_hcl("/r/c.tf", b'variable "n" {}\noutput "n" { value = "v" }\n')
    assert [n["qualified_name"] for n in same.nodes[1:]] == ["/r/c.tf::n", "/r/c.tf::n"]


DEPLOY = b'''apiVersion: apps/v1
kind: Deployment
metadata:
  name: web
  labels: {app: web}
spec:
  template:
    spec:
      volumes:
        - name: v
          configMap: {name: web-cfg}
---
defaults: &d {a: 1}
use: *d
'''


def test_yaml_rows():
    rows = parse_yaml("/r/k/deploy.yaml", DEPLOY)
    assert nodes(rows, "line_start") == [
        ("File", "deploy.yaml", 1), ("Document", "doc0", 1), ("K8sResource", "Deployment/web", 1), ("Section", "Deployment/web.metadata", 3), ("Section", "Deployment/web.spec", 6), ("Document", "doc1", 13),
        ("Anchor", "&d", 13), ("Section", "doc1.defaults", 13), ("Section", "doc1.use", 14),
    ]
    assert len(edges(rows, "CONTAINS")) == 8
    assert edges(rows, "REFERENCES") == [("REFERENCES", "::Deployment/web", "k8s::ConfigMap/web-cfg", 1), ("REFERENCES", "::doc1", "::&d", 14)]


def test_yaml_single_document_and_values():
    rows = parse_yaml("/r/values.yaml", b"on: yes\nn: 0x1F\nt: 'q'\nf: 1.5\nempty:\nlist: [1, 2]\nlong: " + b"x" * 201 + b"\non: again\n")
    extra = {n["name"]: json.loads(n["extra"]) for n in rows.nodes[1:]}
    assert [n["kind"] for n in rows.nodes] == ["File"] + ["Section"] * 7
    assert extra["on"] == {"key": "on", "helm": True, "value_type": "str", "value": "yes"}
    assert extra["n"]["value_type"] == "HexInt" and extra["n"]["value"] == "31" and extra["t"]["value_type"] == "SingleQuotedScalarString"
    assert extra["f"]["value_type"] == "ScalarFloat" and extra["empty"] == {"key": "empty", "helm": True, "value_type": "NoneType"} and extra["list"]["length"] == 2 and "value" not in extra["long"]


@pytest.mark.parametrize("content", [b"a: {{ .Values.x }}\n  b: [", b"", b"# only a comment\n", b"key: [unclosed"])
def test_yaml_without_documents(content):
    assert nodes(parse_yaml("/r/t.yml", content)) == [("File", "t.yml")]


def test_yaml_manifest_references():
    rows = parse_yaml(
        "/r/s.yaml",
        b"""apiVersion: v1
kind: StatefulSet
metadata: {name: db, namespace: prod, annotations: {short: x, long: """ + b"y" * 300 + b"""}}
spec:
  serviceName: db-svc
  template: {spec: {volumes: [{secret: {secretName: s1}}], containers: [{envFrom: [{configMapRef: {name: c1}}, {secretRef: {name: s2}}]}], initContainers: [{envFrom: [{configMapRef: {name: c2}}]}]}}
""",
    )
    assert [e[2] for e in edges(rows, "REFERENCES")] == ["k8s::Secret/s1", "k8s::ConfigMap/c1", "k8s::Secret/s2", "k8s::ConfigMap/c2", "k8s::Service/db-svc"]
    assert json.loads(rows.nodes[1]["extra"]) == {"apiVersion": "v1", "k8s_kind": "StatefulSet", "namespace": "prod", "annotations": {"short": "x"}}


PAGE = b'''{% extends "base.j2" %}
{% macro btn(label) %}<b>{{ label }}</b>{% endmacro %}
{% block body %}{{ title }} {{ btn(title) }}{% endblock %}
{{ footer }}'''


def test_jinja_rows():
    rows = parse_jinja("/r/t/page.j2", PAGE)
    assert [n["qualified_name"].removeprefix("/r/t/page.j2") for n in rows.nodes] == ["", "::template", "::extends:base.j2", "::block:body", "::var:body:title", "::var:body:btn", "::macro:btn", "::var:btn:label", "::var:template:footer"]
    assert [e[0] for e in edges(rows)] == ["CONTAINS", "EXTENDS", "CONTAINS", "USES_VARIABLE", "USES_VARIABLE", "CALLS_MACRO", "CONTAINS", "USES_VARIABLE", "USES_VARIABLE"]
    assert next(n for n in rows.nodes if n["kind"] == "Macro")["params"] == "label"


def test_jinja_details():
    rows = parse_jinja(
        "/r/t.j2",
        b"""{# {{ no }} #}{% raw %}{{ raw }}{% endraw %}
{% include name ~ ".j2" ignore missing %}
{%- set total = a.b|default(c, boolean=true) -%}
{% for k, v in items.items() if v is not none %}
  {{ k[v] is divisibleby(n) }} {{ 'str {{ x }}' }}
  {% block row scoped %}{{ cell }}
  {% endblock row %}
{% else %}{{ nothing }}{% endfor %}
{% call(user) dump(users) %}{{ user.name }}{% endcall %}
{% macro dump(list, width=size) %}{{ caller(list) }}{% endmacro %}
""",
    )
    names = lambda scope: {n["name"] for n in rows.nodes if n["kind"] == "Variable" and n["parent_name"] == scope}
    assert names("template") == {"name", "total", "a", "c", "k", "v", "items", "n", "nothing", "user", "dump", "users"}
    assert names("row") == {"cell"} and names("dump") == {"list", "width", "size", "caller"}
    assert ("Include", "include:<dynamic>") in nodes(rows)
    assert edges(rows, "CALLS_MACRO") == [("CALLS_MACRO", "::template", "::macro:dump", 9)]
    row = next(n for n in rows.nodes if n["name"] == "row")
    assert (row["line_start"], row["line_end"]) == (6, 6)


@pytest.mark.parametrize("content", [b"{% if x %}", b"{% unknown %}", b"{{ }}", b"{% endblock %}", b"{{ (a }}", b"{% for x %}{% endfor %}", b"{{ a"])
def test_jinja_syntax_error(content):
    rows = parse_jinja("/r/t.j2", content)
    assert nodes(rows) == [("File", "t.j2")] and "parse_error" in rows.nodes[0]["extra"]


def test_registry():
    assert [extension(p) for p in ("a/B.PY", ".py", "x.", "a.b/c", "n.tar.yml")] == [".py", "", "", "", ".yml"]
    assert detect_language("a.tfvars") == "hcl" and detect_language("a.rs") is None
    assert parse_file("/r/a.txt", b"x") == ([], [])
