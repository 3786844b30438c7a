"""Streaming ingestion: new page files are picked up and added batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from liasse import schemas
from liasse.plans import versions
from liasse.plans.ingest import ingest_batch


def page_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Pages arriving as files in a folder."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def ingest_stream(pages: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest a stream of pages. Seen content is remembered in the document table, not in
    operator state; a batch that is tried again adds nothing twice."""
    def add(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch.sparkSession, batch, root, f"stream-{batch_id}")

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_versions(pages: DataFrame, root: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Ingest a stream of pages into a store of commits, with postings and statistics per micro-batch.

    A micro-batch is a commit of its number; one that is handed over again is
    there already and adds nothing.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        versions.ingest(batch.sparkSession, batch, root, f"stream-{batch_id}", again=False, **options)

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
