"""Files that arrive as a stream, kept up to date in a store.

The stream has (file_path, content); a null content says that the file is gone. Each micro-batch replaces the rows of its files. A batch
that is run again after a failure finds the contents stored already and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.ingest import replace_parsed, unstored
from loomgraph.operators.store import GraphStore
from loomgraph.operators.tables import staged
from loomgraph.sources.registry import is_supported, parse_files


def apply_batch(store: GraphStore, files: DataFrame) -> None:
    """Bring the files of one batch up to date; of several contents of a file the last by ``arrived`` counts, if there is such a column, and the largest hash among equals."""
    order = [F.col("arrived").desc()] if "arrived" in files.columns else []
    last = Window.partitionBy("file_path").orderBy(*order, F.sha2("content", 256).desc_nulls_last())
    batch = staged(files.filter("file_path IS NOT NULL").withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("file_path", "content"), "batch")
    known = batch.filter("content IS NOT NULL").filter(is_supported(F.col("file_path")))
    first = store.begin()
    parsed = staged(parse_files(unstored(known, store)), "parsed")
    removed = batch.filter("content IS NULL").select("file_path")
    if not parsed.isEmpty() or not removed.isEmpty():
        replace_parsed(store, parsed, removed, "stream", first)


def follow(store: GraphStore, files: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query that keeps ``store`` up to date with a stream of files; with ``once`` it ends when it has seen what is there."""
    writer = files.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
