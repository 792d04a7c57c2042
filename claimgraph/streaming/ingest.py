"""Micro-batch ingest: new files become patches, one version of the store a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgraph.engine import Engine
from claimgraph.sources.documents import modality_of, registered


def watch(engine: Engine, folder: str, checkpoint: str, at: str, commit: bool = False, available_now: bool = True) -> StreamingQuery:
    """Ingest every file that appears in ``folder`` once.

    A batch that is run again after a failure finds its documents registered or under review, so nothing is staged twice.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = engine.spark.readStream.format("binaryFile").schema(schema).load(folder)
    rows = files.select(F.col("path").alias("source_uri"), modality_of(F.col("path")).alias("modality"), *registered(F.col("content")), F.col("content").cast("string").alias("text"))

    def batch(df: DataFrame, _: int) -> None:
        engine.ingest(df.filter("modality IS NOT NULL"), at)
        if commit:
            engine.commit(at)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
