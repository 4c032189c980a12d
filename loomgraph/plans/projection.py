"""The synthetic star schema as a property graph, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.tables import bytes_of, sized

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _node(source: str, kind: str, name: str, path: str, language: str, order: str, parent: str = "''", params: str = "''", test: str = "false", line: str = "1") -> str:
    key = path if kind == "File" else f"concat({path}, '::', {name})"
    return (
        f"SELECT '{kind}' AS kind, {name} AS name, {key} AS qualified_name, {path} AS file_path, CAST({line} AS INT) AS line_start, CAST({line} AS INT) AS line_end, '{language}' AS language, "
        f"{parent} AS parent_name, {params} AS params, '' AS return_type, '' AS modifiers, {test} AS is_test, {order} AS ord FROM {source}"
    )


def _edge(source: str, kind: str, a: str, b: str, path: str, order: str, line: str = "0") -> str:
    return f"SELECT '{kind}' AS kind, {a} AS source_qualified, {b} AS target_qualified, {path} AS file_path, CAST({line} AS INT) AS line, {order} AS ord FROM {source}"


_REGION, _CUST, _SUPP, _ORD, _PART = (
    "concat('region/', CAST({} AS VARCHAR(20)))", "concat('cust/', CAST({} AS VARCHAR(20)))", "concat('supp/', CAST({} AS VARCHAR(20)))",
    "concat('ord/', CAST({} % 100 AS VARCHAR(20)))", "concat('part/', {})",
)


def _named(prefix: str, column: str) -> str:
    return f"concat('{prefix}', CAST({column} AS VARCHAR(20)))"


def _at(path: str, name: str) -> str:
    return f"concat({path}, '::', {name})"


_NATION = _at(_REGION.format("n_regionkey"), _named("nation_", "n_nationkey"))
_CUSTOMER = _at(_CUST.format("c_nationkey"), _named("customer_", "c_custkey"))
_SUPPLIER = _at(_SUPP.format("s_nationkey"), _named("supplier_", "s_suppkey"))
_ORDER = _at(_ORD.format("o_orderkey"), _named("order_", "o_orderkey"))
_PARTKEY = _at(_PART.format("p_brand"), _named("", "p_partkey"))
_ITEMS = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_STEP = 100_000_000_000

NODES_SQL = " UNION ALL ".join(
    [
        _node("{region}", "File", "r_name", _REGION.format("r_regionkey"), "geo", "CAST(r_regionkey AS BIGINT)"),
        _node("{nation}", "Section", _named("nation_", "n_nationkey"), _REGION.format("n_regionkey"), "geo", f"{_STEP} + n_nationkey", parent="n_name"),
        _node("{nation}", "File", "n_name", _CUST.format("n_nationkey"), "crm", f"{2 * _STEP} + n_nationkey"),
        _node("{customer}", "Class", _named("customer_", "c_custkey"), _CUST.format("c_nationkey"), "crm", f"{3 * _STEP} + c_custkey", params="c_mktsegment"),
        _node("{nation}", "File", "n_name", _SUPP.format("n_nationkey"), "supply", f"{4 * _STEP} + n_nationkey"),
        _node("{supplier}", "Resource", _named("supplier_", "s_suppkey"), _SUPP.format("s_nationkey"), "supply", f"{5 * _STEP} + s_suppkey"),
        _node("(SELECT DISTINCT o_orderkey % 100 AS k FROM {orders}) f", "File", _named("ord_", "k"), _ORD.format("k"), "sales", f"{6 * _STEP} + k"),
        _node("{orders}", "Function", _named("order_", "o_orderkey"), _ORD.format("o_orderkey"), "sales", f"{7 * _STEP} + o_orderkey", params="o_orderpriority", test="o_orderpriority LIKE '1-%'", line="o_orderkey % 1000"),
        _node("(SELECT DISTINCT p_brand, CAST(regexp_replace(p_brand, '[^0-9]', '') AS BIGINT) AS k FROM {part}) b", "File", "p_brand", _PART.format("p_brand"), "", f"{8 * _STEP} + k"),
        _node("{part}", "Variable", _named("", "p_partkey"), _PART.format("p_brand"), "catalog", f"{9 * _STEP} + p_partkey", parent="p_type"),
    ]
).replace("regexp_replace(p_brand, '[^0-9]', '')", "replace(p_brand, 'Brand#', '')")

EDGES_SQL = " UNION ALL ".join(
    [
        _edge("{nation}", "CONTAINS", _REGION.format("n_regionkey"), _NATION, _REGION.format("n_regionkey"), "CAST(n_nationkey AS BIGINT)"),
        _edge("{customer}", "CONTAINS", _CUST.format("c_nationkey"), _CUSTOMER, _CUST.format("c_nationkey"), f"{_STEP} + c_custkey"),
        _edge("{supplier}", "CONTAINS", _SUPP.format("s_nationkey"), _SUPPLIER, _SUPP.format("s_nationkey"), f"{2 * _STEP} + s_suppkey"),
        _edge("{orders}", "CONTAINS", _ORD.format("o_orderkey"), _ORDER, _ORD.format("o_orderkey"), f"{3 * _STEP} + o_orderkey"),
        _edge("{part}", "CONTAINS", _PART.format("p_brand"), _PARTKEY, _PART.format("p_brand"), f"{4 * _STEP} + p_partkey"),
        _edge("{customer} JOIN {nation} ON c_nationkey = n_nationkey", "REFERENCES", _CUSTOMER, _NATION, _CUST.format("c_nationkey"), f"{5 * _STEP} + c_custkey"),
        _edge("{supplier} JOIN {nation} ON s_nationkey = n_nationkey", "REFERENCES", _SUPPLIER, _NATION, _SUPP.format("s_nationkey"), f"{6 * _STEP} + s_suppkey"),
        _edge("{orders} JOIN {customer} ON o_custkey = c_custkey", "CALLS", _ORDER, _CUSTOMER, _ORD.format("o_orderkey"), f"{7 * _STEP} + o_orderkey"),
        _edge("{orders} JOIN {customer} ON o_custkey = c_custkey AND o_orderpriority LIKE '1-%'", "TESTED_BY", _ORDER, _CUSTOMER, _ORD.format("o_orderkey"), f"{8 * _STEP} + o_orderkey"),
        _edge(_ITEMS + " JOIN {part} ON l_partkey = p_partkey", "READS_CONFIG", _ORDER, _PARTKEY, _ORD.format("o_orderkey"), f"{9 * _STEP} + l_orderkey * 10 + l_linenumber", line="l_linenumber"),
        _edge(_ITEMS + " JOIN {supplier} ON l_suppkey = s_suppkey", "RENDERS", _ORDER, _SUPPLIER, _ORD.format("o_orderkey"), f"{10 * _STEP} + l_orderkey * 10 + l_linenumber", line="l_linenumber"),
        _edge("(SELECT DISTINCT l_orderkey % 100 AS k, s_nationkey FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey) i", "IMPORTS", _ORD.format("k"), _SUPP.format("s_nationkey"), _ORD.format("k"), f"{11 * _STEP} + k * 100 + s_nationkey"),
        _edge("{part}", "INHERITS", _PARTKEY, _PART.format("p_brand"), _PART.format("p_brand"), f"{12 * _STEP} + p_partkey"),
        _edge("(SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem} WHERE l_returnflag = 'R') u JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey", "USES_MODULE", _SUPPLIER, _PARTKEY, _SUPP.format("s_nationkey"), f"{13 * _STEP} + l_suppkey * 10000000 + l_partkey"),
        _edge("{supplier}", "PASSES_VAR", _SUPPLIER, "concat('pass::', CAST(s_nationkey AS VARCHAR(20)))", _SUPP.format("s_nationkey"), f"{14 * _STEP} + s_suppkey"),
    ]
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the star schema, in a session whose shuffles have partitions by the size of its tables."""
    paths = {t: f"{sf_dir}/{t}.parquet" for t in TABLES}
    own = sized(spark, bytes_of(spark, list(paths.values())))
    tables = {t: own.read.parquet(path) for t, path in paths.items()}
    return tuple(own.sql(sql, **{t: df for t, df in tables.items() if "{" + t + "}" in sql}) for sql in (NODES_SQL, EDGES_SQL))  # type: ignore[return-value]


def duckdb_graph() -> str:
    """The same two tables as the beginning of a DuckDB query."""
    names = {t: t for t in TABLES}
    return f"WITH RECURSIVE nodes AS ({NODES_SQL.format(**names)}), edges AS ({EDGES_SQL.format(**names)})"
