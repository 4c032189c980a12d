"""Queries of this subpackage over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chat, decontam, licenses, linededup, packing, quality, sharding, simhash, spandedup, tokenout


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents = _table("documents")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign_shards(_documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training window and position of every piece of every document."""
    return packing.pack_documents(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated line windows."""
    return linededup.dedup_lines(_documents(spark, sf_dir), removed="lines_removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated sentence spans."""
    return spandedup.dedup_spans(_documents(spark, sf_dir), removed="sentences_removed")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of token ids with its slot, shard and offset in training order, and the path of the shard, which is written."""
    return tokenout.written_sequences(_documents(spark, sf_dir))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training window of every conversation, with whole system turns."""
    return chat.chat_windows(_table("conversations")(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds."""
    return decontam.contaminated(_documents(spark, sf_dir), _table("benchmark")(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats another one nearly, with the one that its group keeps."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the quality rule keeps, with its lines and its share of content."""
    docs = _documents(spark, sf_dir)
    field = quality.fit(docs, _table("labels")(spark, sf_dir))
    return quality.assess(docs, field).filter("kept").drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_output": op5_token_output,
    "op6_chat_windows": op6_chat_windows,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_quality_rules": op10_quality_rules,
}

_SHARD_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(sharding.SHARDS))

ORACLE_SQL: dict[str, str] = {
    # The turns of the shards, one step of the recursion each: claim the first free slot of the order of shard t % n.
    "op1_sharding": f"""
WITH RECURSIVE shards(i, name) AS (VALUES {_SHARD_ROWS}),
pref AS (
  SELECT list(('0x' || substr(md5(name || '/offset'), 1, 8))::BIGINT % {sharding.TABLE_SIZE} ORDER BY i) AS o,
         list(('0x' || substr(md5(name || '/skip'), 1, 8))::BIGINT % {sharding.TABLE_SIZE - 1} + 1 ORDER BY i) AS k
  FROM shards),
fill(t, slot, taken) AS (
  SELECT 0::BIGINT, -1::BIGINT, repeat('0', {sharding.TABLE_SIZE})::BITSTRING
  UNION ALL
  SELECT t + 1, s, set_bit(taken, s::INT, 1)
  FROM (SELECT t, taken, list_first(list_filter(
          list_transform(range({sharding.TABLE_SIZE}), lambda j: (o[t % {len(sharding.SHARDS)} + 1] + j * k[t % {len(sharding.SHARDS)} + 1]) % {sharding.TABLE_SIZE}),
          lambda x: get_bit(taken, x::INT) = 0)) AS s
        FROM fill, pref WHERE t < {sharding.TABLE_SIZE})),
placed AS (SELECT slot, name AS shard FROM fill JOIN shards ON i = (t - 1) % {len(sharding.SHARDS)} WHERE t > 0),
keyed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, shard FROM keyed JOIN placed USING (slot)""",
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS i FROM l)
      WHERE trim(ls[i] || ls[i + 1] || ls[i + 2], ' ') <> ''),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS spots FROM r WHERE n > 1 GROUP BY doc_id)
SELECT doc_id,
       CASE WHEN spots IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda p: NOT list_contains(spots, p)), lambda p: ls[p]), chr(10)) END AS text,
       coalesce(len(spots), 0)::INT AS lines_removed
FROM l LEFT JOIN gone USING (doc_id)""",
    "op4_substring_dedup": f"""
WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?;:,][ \\t\\r\\n]+|[{spandedup.MARKS}][ \\t\\r\\n]*|\\n[ \\t\\r\\n]*)', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
n AS (SELECT doc_id, list_transform(ss, lambda s: lower(trim(s, ' ' || chr(9) || chr(13) || chr(10)))) AS t FROM l),
s AS (SELECT doc_id, i, len(t) AS m, length(t[i]) AS c, sum(length(t[i])) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM n)),
far AS (SELECT doc_id, z, min(i) AS j FROM s GROUP BY doc_id, z),
e AS (SELECT s.doc_id AS doc_id, s.i AS i, s.m AS m, greatest(f.j, s.i + {spandedup.SENTENCES - 1}) AS j FROM s ASOF JOIN far f ON s.doc_id = f.doc_id AND s.z - s.c + {spandedup.MIN_CHARS} <= f.z),
r AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(t[i:j], chr(10)) ORDER BY doc_id, i) AS k FROM e JOIN n USING (doc_id) WHERE j <= m),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, j + 1)))) AS spots FROM r WHERE k > 1 GROUP BY doc_id)
SELECT doc_id,
       CASE WHEN spots IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda p: NOT list_contains(spots, p)), lambda p: ss[p]), '') END AS text,
       coalesce(len(spots), 0)::INT AS sentences_removed
FROM l LEFT JOIN gone USING (doc_id)""",
}
