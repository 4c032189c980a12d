"""The corpus pipeline: quality rules, line deduplication, near-duplicates, decontamination, packing.

Each stage takes all that the one before it kept; what it returns is written as Parquet and read again as the next one's documents.
Extra columns of documents come along under their names, whatever these are; all stages take an empty table and return one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, linededup, packing, quality, simhash
from loomgraph.operators.tables import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose content lines outweigh their boilerplate.

    Null and empty texts and those of white space alone go. A share of content that equals the least one is kept. Copies are kept or go
    alike. Without labels of both kinds every line is content. Documents of any length are decoded whole.
    """
    return quality.keep_content(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line windows; ``n_chars`` follows the text. Those of which every line goes, go.

    The first occurrence by (id, hash of the text, line) stays, null ids before others. Null texts and texts that were empty before stay as they
    are. Rows equal in id and text count as one document and come out alike. Documents with fewer lines than a window are unchanged, long ones are compared whole.
    """
    cut = linededup.dedup_lines(docs).filter("text IS NULL OR text <> ''").unionByName(docs.filter("text = ''"))
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id, null before others, for equal ids the least hash of the text.

    Texts without words (null ones, empty ones) are in no group and stay. Of rows equal in id and text one stays. Long texts count whole.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; neither do items without words, and an empty benchmark takes nothing out. Copies are kept or go alike. Long texts are searched
    whole.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows.

    Null and empty texts have no piece. Copies are packed as often as they occur. Documents go by id, null first, then by the hash of the text. A text of any
    length is cut into whole windows and a rest.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can't express the first stage, a trained field, nor the online packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
