"""Tables in the folder that all executors share: staged results and snapshots of a store."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHUFFLE, _FIRST, _ADVISED, _HASHED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
#: Bytes of input files for each partition of a shuffle in a session of ``sized``.
PARTITION_BYTES = 6 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master, where one machine is all there is, a folder of our own if it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bytes_of(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of some files or folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in at)


def sized(spark: SparkSession, size: int) -> SparkSession:
    """A session like ``spark``, which stays as it is, with as many partitions of a shuffle as ``size`` bytes of input files want, at least those set.

    A fixed number of partitions gives each task a share that grows with the input. Adaptive execution joins small partitions, so many do no harm. Joins whose
    smaller side has small partitions alone are joins by hash: that side is in memory, neither is sorted.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    wanted = -(-size // PARTITION_BYTES)
    for name in (_SHUFFLE, _FIRST):
        if name == _SHUFFLE or own.conf.get(name, None):
            own.conf.set(name, max(wanted, int(own.conf.get(name))))
    own.conf.set(_HASHED, own.conf.get(_ADVISED))
    return own


def grouped(rows: DataFrame, *keys: str) -> GroupedData:
    """``rows`` grouped by texts of which hardly any are alike, with a hash of them as ``_hash``, for aggregates of texts, which Spark sorts for.

    They are shuffled first, so they aren't sorted in the tasks that read them too, and sorted by the hash, as texts of one file begin alike.
    """
    return rows.repartition(*keys).withColumn("_hash", F.xxhash64(*keys)).groupBy("_hash", *keys)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Some settings of Spark's SQL, with __ for each dot, while a table is staged."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in a new folder of the shared one and read it back: cuts the plan, and survives the loss of executors.

    The shuffle files of the write go when it is done; nothing reads them any more. The folder is left for the cluster's clean-up of the
    shared one, as later actions on the result read it.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
