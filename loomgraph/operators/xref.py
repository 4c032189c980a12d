"""Edges across files and languages, found by joins after parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import last_segment, parent_dir
from loomgraph.operators.joins import first_per, resolve_refs
from loomgraph.operators.schema import EDGE_DDL

YAML_CALLS = ("dump", "load", "load_all", "safe_dump", "safe_load", "safe_load_all")
TEMPLATE_CALLS = ("get_template", "render_template", "render_template_string")
FILE_CALL = r"(?:file|yamldecode|templatefile)\s*\(\s*\\?[\"']([^\"'\\]+)\\?[\"']"
REMOTE_OUTPUT = r"data\.terraform_remote_state\.([A-Za-z0-9_\-]+)\.outputs\.([A-Za-z0-9_]+)"
#: Order of the detectors' edges after all others.
_BASE = 1 << 60


def _raw_target(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'CALLS'").withColumn("ref", F.coalesce(F.get_json_object("extra", "$.raw_target"), F.lit("")))


def _edge(rows: DataFrame, kind, extra, line, base: int) -> DataFrame:  # type: ignore[no-untyped-def]
    within = F.col("_within") if "_within" in rows.columns else F.lit(0)
    rows = rows.select(kind.alias("kind"), "source_qualified", F.col("target").alias("target_qualified"), "file_path", line.cast("int").alias("line"), extra.alias("extra"), (F.lit(_BASE + base) + F.col("ord")).alias("ord"), within.alias("_within"))
    return first_per(rows, ["source_qualified", "target_qualified"], ["ord", "_within"]).drop("_within")


def calls_to_config(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """READS_CONFIG: a function that calls a YAML reader, and the files named by calls of the same file."""
    calls = _raw_target(edges)
    python = nodes.filter("language = 'python'").select(F.col("qualified_name").alias("source_qualified"))
    readers = calls.filter(last_segment(F.col("target_qualified")).isin(*YAML_CALLS)).join(python, "source_qualified", "left_semi").select("source_qualified", "file_path", "line", "ord")
    refs = calls.filter(F.col("ref").endswith(".yaml") | F.col("ref").endswith(".yml")).select("file_path", "ref", F.col("ord").alias("_ref_ord"))
    found = resolve_refs(readers.join(refs, "file_path"), nodes).withColumn("_within", F.col("_ref_ord"))
    return _edge(found, F.lit("READS_CONFIG"), F.to_json(F.struct(F.lit("crossref").alias("detected_by"), F.col("ref").alias("config_file"))), F.col("line"), 0)


def calls_to_template(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """RENDERS: a call of a template loader with the name of a file."""
    calls = _raw_target(edges).filter(last_segment(F.col("target_qualified")).isin(*TEMPLATE_CALLS) & (F.col("ref") != ""))
    return _edge(resolve_refs(calls, nodes), F.lit("RENDERS"), F.to_json(F.struct(F.lit("crossref").alias("detected_by"), F.col("ref").alias("template"))), F.col("line"), 1 << 57)


def text_to_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """READS_CONFIG and RENDERS: file functions in the values of HCL blocks."""
    refs = nodes.filter("language = 'hcl'").select(F.col("qualified_name").alias("source_qualified"), "file_path", "ord", F.posexplode(F.regexp_extract_all("extra", F.lit(FILE_CALL), 1)).alias("_i", "ref"))
    refs = refs.filter(F.col("ref").rlike(r"\.(yaml|yml|json|j2|tpl)$")).withColumn("_within", F.col("_i"))
    kind = F.when(F.col("ref").rlike(r"\.(j2|tpl)$"), "RENDERS").otherwise("READS_CONFIG")
    return _edge(resolve_refs(refs, nodes), kind, F.to_json(F.struct(F.lit("crossref").alias("detected_by"), F.col("ref").alias("reference"))), F.lit(0), 2 << 57)


def remote_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """REMOTE_STATE: a remote state, and the outputs of that name in other folders which its file reads."""
    states = nodes.filter("kind = 'DataSource' AND name LIKE 'terraform\\_remote\\_state.%'").select(F.col("qualified_name").alias("source_qualified"), "file_path", F.col("name").alias("state"), F.regexp_replace("name", r"^[^.]*\.", "").alias("label"), "ord")
    texts = nodes.select("file_path", "extra").unionByName(edges.select("file_path", "extra"))
    texts = texts.join(states.select("file_path").distinct(), "file_path", "left_semi").filter(F.col("extra").contains("terraform_remote_state"))
    used = texts.select("file_path", F.explode(F.arrays_zip(F.regexp_extract_all("extra", F.lit(REMOTE_OUTPUT), 1).alias("label"), F.regexp_extract_all("extra", F.lit(REMOTE_OUTPUT), 2).alias("output"))).alias("_u")).select("file_path", "_u.label", "_u.output").distinct()
    outputs = nodes.filter("kind = 'Output'").select(F.col("name").alias("output"), F.col("qualified_name").alias("target"), F.col("file_path").alias("_there"))
    found = states.join(used, ["file_path", "label"]).join(outputs, "output").filter(parent_dir(F.col("_there")) != parent_dir(F.col("file_path")))
    extra = F.to_json(F.struct(F.lit("crossref").alias("detected_by"), F.col("state").alias("remote_state"), "output"))
    return _edge(found, F.lit("REMOTE_STATE"), extra, F.lit(0), 3 << 57)


Detector = Callable[[DataFrame, DataFrame], DataFrame]
#: Detectors in order; ``register_detector`` adds to them.
DETECTORS: list[Detector] = [calls_to_config, calls_to_template, text_to_file, remote_outputs]


def register_detector(detector: Detector) -> None:
    """Add a function (nodes, edges) -> edges to those that a build runs."""
    DETECTORS.append(detector)


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of all detectors."""
    out = None
    for detector in DETECTORS:
        found = detector(nodes, edges).select([f.split()[0] for f in EDGE_DDL.split(", ")])
        out = found if out is None else out.unionByName(found)
    return out


def linked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opt-in: (edges with their targets resolved as far as ``resolve_symbols`` goes, the edges of all detectors, to which a call goes by its last name: ``yaml.load`` is ``load``)."""
    short = F.when(F.col("kind") == "CALLS", F.regexp_replace("target_qualified", r"^.*\.", "")).otherwise(F.col("target_qualified"))
    return resolve_symbols(nodes, edges), detect(nodes, edges.withColumn("target_qualified", short))


def resolve_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Opt-in: edges whose target text names a symbol of the same file, or a labelled manifest, get that node's key; others stay."""
    named = nodes.filter("kind IN ('Class', 'Function', 'Method')").groupBy("file_path", F.col("name").alias("_t")).agg(F.max_by("qualified_name", "ord").alias("_key"))
    manifests = nodes.filter("kind = 'K8sResource'").groupBy(F.concat(F.lit("k8s::"), F.col("name")).alias("_t")).agg(F.max_by("qualified_name", "ord").alias("_label"))
    text = F.when(F.col("kind").isin("CALLS", "INHERITS"), F.regexp_replace("target_qualified", r"^self\.", "")).otherwise(F.col("target_qualified"))
    joined = edges.withColumn("_t", text).join(named, ["file_path", "_t"], "left").join(manifests, "_t", "left")
    target = F.when(F.col("kind").isin("CALLS", "INHERITS"), F.col("_key"))
    return joined.withColumn("target_qualified", F.coalesce(target, "_label", "target_qualified")).select(edges.columns)
