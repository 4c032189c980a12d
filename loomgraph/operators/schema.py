"""Schemas of the property graph and the key of a node."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_DDL = (
    "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, "
    "params string, return_type string, modifiers string, is_test boolean, file_hash string, extra string, ord long"
)
EDGE_DDL = "kind string, source_qualified string, target_qualified string, file_path string, line int, extra string, ord long"
METADATA_DDL = "key string, value string"
EDGE_KEY = ["kind", "source_qualified", "target_qualified", "file_path", "line"]

#: Kinds of edges along which a change spreads.
DEPENDENCY_KINDS = (
    "CALLS CALLS_MACRO DEPENDS_ON EXTENDS IMPLEMENTS IMPORTS IMPORTS_FROM INCLUDES INHERITS PASSES_VAR READS_CONFIG REFERENCES REMOTE_STATE RENDERS TESTED_BY USES_MODULE USES_VARIABLE".split()
)


def node_key(file_path: Column, kind: Column, name: Column) -> Column:
    """The key of a node: the path itself for a file, else path and name; the kind is no part of it."""
    return F.when(kind == "File", file_path).otherwise(F.concat_ws("::", file_path, name))


def make_key(file_path: str, kind: str, name: str) -> str:
    """``node_key`` for plain strings."""
    return file_path if kind == "File" else f"{file_path}::{name}"
