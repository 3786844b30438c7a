"""Incremental ingestion of a batch of pages into a stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liasse.operators.chunking import build_chunks
from liasse.session import path_exists
from liasse.sources import corpus


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return corpus.read_table(spark, root, name) if path_exists(spark, f"{root}/{name}") else None


def ingest_batch(spark: SparkSession, pages: DataFrame, root: str, batch: str, by_name: bool = False) -> None:
    """Add the new documents of a batch; known content is skipped (``by_name``: under the same name only), ordinals go on.

    The new pages and the packed pages are written once under ``staging``, so
    no later step reads the source again; digests, units and tags are worked out once. Both corpus tables are partitioned
    by case and batch and a batch overwrites only its own partitions, so a
    batch that is run again after a failure leaves the same rows once.
    """
    known, stored = _stored(spark, root, "documents"), _stored(spark, root, "chunks")
    if known is not None:
        known = known.filter(F.col("batch") != batch)
    fresh = corpus.ingest_incremental(corpus.valid_cases(pages), known, by_name)
    staged = f"{root}/staging/{batch}"
    fresh.write.mode("overwrite").parquet(f"{staged}/pages")
    new = spark.read.parquet(f"{staged}/pages").drop("content_hash")
    base = None
    if stored is not None:
        earlier = stored.filter(F.col("batch") != batch)
        base = earlier.groupBy("case_id").agg((F.max("chunk_ord") + 1).alias("n_chunks"))
    build_chunks(new, base, staging=staged).write.mode("overwrite").parquet(f"{staged}/chunks")
    chunks = spark.read.parquet(f"{staged}/chunks")
    # units are as the chunks have them, digests as the pages were told apart by
    units, told = spark.read.parquet(f"{staged}/units"), spark.read.parquet(f"{staged}/pages")
    tables = {"chunks": chunks, "documents": corpus.build_catalog(chunks, units, told)}
    corpus.write_corpus({n: t.withColumn("batch", F.lit(batch)) for n, t in tables.items()}, root)
