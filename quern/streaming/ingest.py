"""Incremental ingest (§2.14): new documents become nodes as they arrive, exactly once by the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.plans import techniques


def ingest_stream(docs: DataFrame, technique: techniques.Technique, out: str, checkpoint: str, separator: str = "\n\n", compose: bool = True) -> StreamingQuery:
    """Start writing the nodes of a stream of docs (doc_id, text) to ``out``; stops when what is there is read.

    A batch's files go to a folder of its own, so a batch that is run again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        techniques.ingest(batch, technique, separator=separator, compose=compose).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
