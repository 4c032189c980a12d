"""Source files with a number in them, and the rows that each gives by the rules of its language: what the parsers' queries are held against.

``{k}`` stands for the number and ``{p}`` for the file's path. Nodes are (kind, name, key, first line, last line, parent, parameters, returned type, modifiers, is a
test, extra), edges (kind, source, target, line, extra). The rows were written down from what the parsers gave and then read against the rules, so they hold changes
to account; they aren't an independent derivation. Small hand-derived ones are in the tests.
"""

from __future__ import annotations

from typing import NamedTuple


class Case(NamedTuple):
    """A file's name, its text, and the rows that it gives."""

    file: str
    text: str
    nodes: list[tuple]
    edges: list[tuple]


CASES: dict[str, Case] = {}
CASES["python"] = Case(
    "p.py",
    """\
import os, sys as system
from yaml import safe_load as load
from . import near{k}

class Base{k}:
    pass

class N{k}(Base{k}, os.PathLike):
    'A nation.'

    @staticmethod
    @wraps(load)
    def read(path: str, *more, depth: int = 3) -> dict:
        def inner():
            return load(path)
        return inner()

    async def test_read(self):
        self.read("n{k}.yaml")

def main{k}(a, /, b=1, **rest):
    N{k}.read("n{k}.yaml")
    for x in rest:
        print(x)

main{k}(1)
""",
    [
        ('File', 'p.py', '{p}', 1, 27, '', '', '', '', False, '{}'),
        ('Class', 'Base{k}', '{p}::Base{k}', 5, 6, '', '', '', '', False, '{}'),
        ('Class', 'N{k}', '{p}::N{k}', 8, 19, '', '', '', '', False, '{}'),
        ('Method', 'read', '{p}::N{k}.read', 13, 16, 'N{k}', 'path: str, *more, depth: int = 3', 'dict', '@staticmethod @wraps', False, '{}'),
        ('Function', 'inner', '{p}::inner', 14, 15, 'N{k}.read', '', '', '', False, '{}'),
        ('Method', 'test_read', '{p}::N{k}.test_read', 18, 19, 'N{k}', 'self', '', '', True, '{}'),
        ('Function', 'main{k}', '{p}::main{k}', 21, 24, '', 'a, /, b=1, **rest', '', '', False, '{}'),
    ],
    [
        ('IMPORTS', '{p}', 'os', 1, '{"import_type": "module"}'),
        ('IMPORTS', '{p}', 'sys', 1, '{"import_type": "module"}'),
        ('IMPORTS', '{p}', 'yaml.safe_load', 2, '{"import_type": "from", "module": "yaml"}'),
        ('IMPORTS', '{p}', '..near{k}', 3, '{"import_type": "from", "module": "."}'),
        ('CONTAINS', '{p}', '{p}::Base{k}', 5, '{}'),
        ('CONTAINS', '{p}', '{p}::N{k}', 8, '{}'),
        ('INHERITS', '{p}::N{k}', 'Base{k}', 8, '{}'),
        ('INHERITS', '{p}::N{k}', 'os.PathLike', 8, '{}'),
        ('CONTAINS', '{p}::N{k}', '{p}::N{k}.read', 13, '{}'),
        ('CALLS', '{p}::N{k}.read', 'inner', 16, '{}'),
        ('CONTAINS', '{p}::N{k}.read', '{p}::inner', 14, '{}'),
        ('CALLS', '{p}::inner', 'load', 15, '{}'),
        ('CONTAINS', '{p}::N{k}', '{p}::N{k}.test_read', 18, '{}'),
        ('CALLS', '{p}::N{k}.test_read', 'self.read', 19, '{}'),
        ('CALLS', '{p}::N{k}.test_read', 'self.read', 19, '{}'),
        ('CONTAINS', '{p}', '{p}::main{k}', 21, '{}'),
        ('CALLS', '{p}::main{k}', 'N{k}.read', 22, '{}'),
        ('CALLS', '{p}::main{k}', 'print', 24, '{}'),
        ('CALLS', '{p}::main{k}', 'N{k}.read', 22, '{}'),
        ('CALLS', '{p}', 'main{k}', 26, '{}'),
    ],
)
CASES["python_broken"] = Case(
    "bad.py",
    """\
def broken{k}(:
    pass
""",
    [
        ('File', 'bad.py', '{p}', 1, 3, '', '', '', '', False, '{"parse_error": "invalid syntax (<unknown>, line 1)"}'),
    ],
    [
    ],
)
CASES["hcl"] = Case(
    "m.tf",
    """\
terraform {
  required_version = ">= 1.0"
}
provider "aws" { region = var.region{k} }
variable "region{k}" {
  type    = string
  default = "eu"
}
locals {
  cfg{k}  = yamldecode(file("n{k}.yaml"))
  both{k} = "${var.region{k}}-${local.cfg{k}}"
}
resource "aws_vpc" "v{k}" {
  cidr       = var.region{k}
  depends_on = [data.aws_ami.a{k}]
}
data "aws_ami" "a{k}" { owner = local.both{k} }
data "terraform_remote_state" "s{k}" { backend = "s3" }
module "m{k}" {
  source = "./near{k}"
  vpc    = aws_vpc.v{k}.id
  policy = data.terraform_remote_state.s{k}.outputs.o{k}
}
module "far{k}" {
  source  = "terraform-aws-modules/vpc/aws"
  version = "5.0"
}
output "o{k}" { value = module.m{k}.id }
""",
    [
        ('File', 'm.tf', '{p}', 0, 0, '', '', '', '', False, '{}'),
        ('TerraformConfig', 'terraform', '{p}::terraform', 0, 0, '', '', '', '', False, '{"required_version": ">= 1.0"}'),
        ('Provider', 'aws', '{p}::aws', 0, 0, '', '', '', '', False, '{"region": "${var.region{k}}", "alias": ""}'),
        ('Variable', 'region{k}', '{p}::region{k}', 0, 0, '', '', '', '', False, '{"type": "${string}", "default": "eu", "description": ""}'),
        ('Local', 'cfg{k}', '{p}::cfg{k}', 0, 0, '', '', '', '', False, '{"value": "${yamldecode(file(\\"n{k}.yaml\\"))}"}'),
        ('Local', 'both{k}', '{p}::both{k}', 0, 0, '', '', '', '', False, '{"value": "${var.region{k}}-${local.cfg{k}}"}'),
        ('Resource', 'aws_vpc.v{k}', '{p}::aws_vpc.v{k}', 0, 0, '', '', '', '', False, '{"provider": "aws", "resource_type": "aws_vpc"}'),
        ('DataSource', 'aws_ami.a{k}', '{p}::aws_ami.a{k}', 0, 0, '', '', '', '', False, '{"provider": "aws", "data_type": "aws_ami"}'),
        ('DataSource', 'terraform_remote_state.s{k}', '{p}::terraform_remote_state.s{k}', 0, 0, '', '', '', '', False, '{"provider": "terraform", "data_type": "terraform_remote_state"}'),
        ('Module', 'm{k}', '{p}::m{k}', 0, 0, '', '', '', '', False, '{"source": "./near{k}"}'),
        ('Module', 'far{k}', '{p}::far{k}', 0, 0, '', '', '', '', False, '{"source": "terraform-aws-modules/vpc/aws"}'),
        ('Output', 'o{k}', '{p}::o{k}', 0, 0, '', '', '', '', False, '{"description": "", "value": "${module.m{k}.id}"}'),
    ],
    [
        ('USES_MODULE', '{p}::m{k}', './near{k}', 0, '{"source_path": "./near{k}"}'),
        ('PASSES_VAR', '{p}::m{k}', '{p}::vpc', 0, '{"var_name": "vpc", "value": "${aws_vpc.v{k}.id}"}'),
        ('PASSES_VAR', '{p}::m{k}', '{p}::policy', 0, '{"var_name": "policy", "value": "${data.terraform_remote_state.s{k}.outputs.o{k}}"}'),
        ('CONTAINS', '{p}', '{p}::terraform', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::aws', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::region{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::cfg{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::both{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::aws_vpc.v{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::aws_ami.a{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::terraform_remote_state.s{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::m{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::far{k}', 0, '{}'),
        ('CONTAINS', '{p}', '{p}::o{k}', 0, '{}'),
        ('REFERENCES', '{p}', '{p}::region{k}', 0, '{}'),
        ('REFERENCES', '{p}', '{p}::cfg{k}', 0, '{}'),
        ('REFERENCES', '{p}::aws_vpc.v{k}', '{p}::region{k}', 0, '{}'),
        ('REFERENCES', '{p}::aws_vpc.v{k}', '{p}::aws_ami.a{k}', 0, '{}'),
        ('REFERENCES', '{p}::aws_ami.a{k}', '{p}::both{k}', 0, '{}'),
        ('REFERENCES', '{p}::m{k}', '{p}::aws_vpc.v{k}', 0, '{}'),
        ('REFERENCES', '{p}::m{k}', '{p}::terraform_remote_state.s{k}', 0, '{}'),
        ('REFERENCES', '{p}::o{k}', '{p}::m{k}', 0, '{}'),
    ],
)
CASES["yaml"] = Case(
    "d.yaml",
    """\
apiVersion: apps/v1
kind: Deployment
metadata:
  name: web{k}
  labels: {app: web, tier: "t{k}"}
spec:
  template:
    spec:
      serviceAccountName: sa{k}
      containers:
        - name: c
          envFrom:
            - secretRef: {name: sec{k}}
            - configMapRef: {name: cfg{k}}
      volumes:
        - name: v
          configMap: {name: cfg{k}}
        - name: p
          persistentVolumeClaim: {claimName: pvc{k}}
---
defaults: &d{k} {a: 1}
use: *d{k}
on: yes
list: [*d{k}, 2]
""",
    [
        ('File', 'd.yaml', '{p}', 1, 25, '', '', '', '', False, '{}'),
        ('Document', 'doc0', '{p}::doc0', 1, 25, 'd.yaml', '', '', '', False, '{"doc_index": 0}'),
        ('K8sResource', 'Deployment/web{k}', '{p}::Deployment/web{k}', 1, 1, 'doc0', '', '', '', False, '{"apiVersion": "apps/v1", "k8s_kind": "Deployment", "labels": {"app": "web", "tier": "t{k}"}}'),
        ('Section', 'Deployment/web{k}.metadata', '{p}::Deployment/web{k}.metadata', 3, 3, 'Deployment/web{k}', '', '', '', False, '{"key": "metadata", "k8s_section": true}'),
        ('Section', 'Deployment/web{k}.spec', '{p}::Deployment/web{k}.spec', 6, 6, 'Deployment/web{k}', '', '', '', False, '{"key": "spec", "k8s_section": true}'),
        ('Document', 'doc1', '{p}::doc1', 21, 25, 'd.yaml', '', '', '', False, '{"doc_index": 1}'),
        ('Anchor', '&d{k}', '{p}::&d{k}', 21, 21, 'doc1', '', '', '', False, '{"anchor_name": "d{k}", "value_type": "mapping"}'),
        ('Section', 'doc1.defaults', '{p}::doc1.defaults', 21, 21, 'doc1', '', '', '', False, '{"key": "defaults", "value_type": "mapping", "child_keys": ["a"]}'),
        ('Section', 'doc1.use', '{p}::doc1.use', 22, 22, 'doc1', '', '', '', False, '{"key": "use", "value_type": "mapping", "child_keys": ["a"]}'),
        ('Section', 'doc1.on', '{p}::doc1.on', 23, 23, 'doc1', '', '', '', False, '{"key": "on", "value_type": "str", "value": "yes"}'),
        ('Section', 'doc1.list', '{p}::doc1.list', 24, 24, 'doc1', '', '', '', False, '{"key": "list", "value_type": "sequence", "length": 2}'),
    ],
    [
        ('CONTAINS', '{p}', '{p}::doc0', 1, '{}'),
        ('CONTAINS', '{p}::doc0', '{p}::Deployment/web{k}', 1, '{}'),
        ('CONTAINS', '{p}::Deployment/web{k}', '{p}::Deployment/web{k}.metadata', 3, '{}'),
        ('CONTAINS', '{p}::Deployment/web{k}', '{p}::Deployment/web{k}.spec', 6, '{}'),
        ('REFERENCES', '{p}::Deployment/web{k}', 'k8s::ConfigMap/cfg{k}', 1, '{"ref_kind": "ConfigMap", "ref_name": "cfg{k}", "unresolved": true}'),
        ('REFERENCES', '{p}::Deployment/web{k}', 'k8s::Secret/sec{k}', 1, '{"ref_kind": "Secret", "ref_name": "sec{k}", "unresolved": true}'),
        ('REFERENCES', '{p}::Deployment/web{k}', 'k8s::ConfigMap/cfg{k}', 1, '{"ref_kind": "ConfigMap", "ref_name": "cfg{k}", "unresolved": true}'),
        ('CONTAINS', '{p}', '{p}::doc1', 21, '{}'),
        ('CONTAINS', '{p}::doc1', '{p}::&d{k}', 21, '{}'),
        ('CONTAINS', '{p}::doc1', '{p}::doc1.defaults', 21, '{}'),
        ('CONTAINS', '{p}::doc1', '{p}::doc1.use', 22, '{}'),
        ('CONTAINS', '{p}::doc1', '{p}::doc1.on', 23, '{}'),
        ('CONTAINS', '{p}::doc1', '{p}::doc1.list', 24, '{}'),
        ('REFERENCES', '{p}::doc1', '{p}::&d{k}', 22, '{"via": "alias", "anchor": "d{k}"}'),
        ('REFERENCES', '{p}::doc1', '{p}::&d{k}', 21, '{"via": "alias", "anchor": "d{k}"}'),
    ],
)
CASES["helm_values"] = Case(
    "values.yaml",
    """\
replicas: 3
image: {repo: x, tag: "1"}
""",
    [
        ('File', 'values.yaml', '{p}', 1, 3, '', '', '', '', False, '{}'),
        ('Section', 'replicas', '{p}::replicas', 1, 1, 'values.yaml', '', '', '', False, '{"key": "replicas", "helm": true, "value_type": "int", "value": "3"}'),
        ('Section', 'image', '{p}::image', 2, 2, 'values.yaml', '', '', '', False, '{"key": "image", "helm": true, "value_type": "mapping", "child_keys": ["repo", "tag"]}'),
    ],
    [
        ('CONTAINS', '{p}', '{p}::replicas', 1, '{}'),
        ('CONTAINS', '{p}', '{p}::image', 2, '{}'),
    ],
)
CASES["go_template"] = Case(
    "h.yaml",
    """\
kind: Service
metadata:
  name: {{ .Release.Name }}-{k}
""",
    [
        ('File', 'h.yaml', '{p}', 1, 4, '', '', '', '', False, '{}'),
    ],
    [
    ],
)
CASES["jinja"] = Case(
    "t.j2",
    """\
{% extends "base{k}.j2" %}
{% import "forms{k}.j2" as forms %}
{% from "other{k}.j2" import card, row as line %}
{% macro btn{k}(label, kind="x") %}<b>{{ label }}</b>{% endmacro %}
{% block body{k} %}{{ title.text }} {{ btn{k}(title) }}{% block inner %}{{ deep }}{% endblock %}{% endblock %}
{% include "foot{k}.j2" %}
{% include name_{k} %}
{% set local = 1 %}{% for x in items %}{{ x }}{{ loop.index }}{% endfor %}
{{ forms.field(local) }} {{ footer{k} | upper }}
""",
    [
        ('File', 't.j2', '{p}', 1, 10, '', '', '', '', False, '{}'),
        ('Template', 'template', '{p}::template', 1, 10, '', '', '', '', False, '{}'),
        ('Extends', 'extends:base{k}.j2', '{p}::extends:base{k}.j2', 1, 1, '', '', '', '', False, '{"parent": "base{k}.j2"}'),
        ('Include', 'include:foot{k}.j2', '{p}::include:foot{k}.j2', 6, 6, '', '', '', '', False, '{"included": "foot{k}.j2"}'),
        ('Include', 'include:<dynamic>', '{p}::include:<dynamic>', 7, 7, '', '', '', '', False, '{"included": "<dynamic>"}'),
        ('Block', 'body{k}', '{p}::block:body{k}', 5, 5, 'template', '', '', '', False, '{}'),
        ('Variable', 'title', '{p}::var:body{k}:title', 5, 5, 'body{k}', '', '', '', False, '{}'),
        ('Variable', 'btn{k}', '{p}::var:body{k}:btn{k}', 5, 5, 'body{k}', '', '', '', False, '{}'),
        ('Block', 'inner', '{p}::block:inner', 5, 5, 'template', '', '', '', False, '{}'),
        ('Variable', 'deep', '{p}::var:inner:deep', 5, 5, 'inner', '', '', '', False, '{}'),
        ('Macro', 'btn{k}', '{p}::macro:btn{k}', 4, 4, 'template', 'label, kind', '', '', False, '{}'),
        ('Variable', 'label', '{p}::var:btn{k}:label', 4, 4, 'btn{k}', '', '', '', False, '{}'),
        ('Variable', 'kind', '{p}::var:btn{k}:kind', 4, 4, 'btn{k}', '', '', '', False, '{}'),
        ('Variable', 'name_{k}', '{p}::var:template:name_{k}', 7, 7, 'template', '', '', '', False, '{}'),
        ('Variable', 'local', '{p}::var:template:local', 8, 8, 'template', '', '', '', False, '{}'),
        ('Variable', 'x', '{p}::var:template:x', 8, 8, 'template', '', '', '', False, '{}'),
        ('Variable', 'items', '{p}::var:template:items', 8, 8, 'template', '', '', '', False, '{}'),
        ('Variable', 'loop', '{p}::var:template:loop', 8, 8, 'template', '', '', '', False, '{}'),
        ('Variable', 'forms', '{p}::var:template:forms', 9, 9, 'template', '', '', '', False, '{}'),
        ('Variable', 'footer{k}', '{p}::var:template:footer{k}', 9, 9, 'template', '', '', '', False, '{}'),
    ],
    [
        ('CONTAINS', '{p}', '{p}::template', 1, '{}'),
        ('EXTENDS', '{p}::template', '{p}::extends:base{k}.j2', 1, '{"parent_template": "base{k}.j2"}'),
        ('INCLUDES', '{p}::template', '{p}::include:foot{k}.j2', 6, '{"included_template": "foot{k}.j2"}'),
        ('INCLUDES', '{p}::template', '{p}::include:<dynamic>', 7, '{"included_template": "<dynamic>"}'),
        ('CONTAINS', '{p}::template', '{p}::block:body{k}', 5, '{}'),
        ('USES_VARIABLE', '{p}::block:body{k}', '{p}::var:body{k}:title', 5, '{"variable": "title"}'),
        ('USES_VARIABLE', '{p}::block:body{k}', '{p}::var:body{k}:btn{k}', 5, '{"variable": "btn{k}"}'),
        ('CALLS_MACRO', '{p}::block:body{k}', '{p}::macro:btn{k}', 5, '{"macro": "btn{k}"}'),
        ('CONTAINS', '{p}::template', '{p}::block:inner', 5, '{}'),
        ('USES_VARIABLE', '{p}::block:inner', '{p}::var:inner:deep', 5, '{"variable": "deep"}'),
        ('CONTAINS', '{p}::template', '{p}::macro:btn{k}', 4, '{}'),
        ('USES_VARIABLE', '{p}::macro:btn{k}', '{p}::var:btn{k}:label', 4, '{"variable": "label"}'),
        ('USES_VARIABLE', '{p}::macro:btn{k}', '{p}::var:btn{k}:kind', 4, '{"variable": "kind"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:name_{k}', 7, '{"variable": "name_{k}"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:local', 8, '{"variable": "local"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:x', 8, '{"variable": "x"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:items', 8, '{"variable": "items"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:loop', 8, '{"variable": "loop"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:forms', 9, '{"variable": "forms"}'),
        ('USES_VARIABLE', '{p}::template', '{p}::var:template:footer{k}', 9, '{"variable": "footer{k}"}'),
    ],
)
CASES["jinja_broken"] = Case(
    "b.j2",
    """\
{% block a{k} %}
{{ x
""",
    [
        ('File', 'b.j2', '{p}', 1, 3, '', '', '', '', False, '{"parse_error": "missing \'}}\'"}'),
    ],
    [
    ],
)
