"""The given tables bound to pages, chunks, persons, queries and vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liasse.session import spread, written_once
from liasse.workload import casefile


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of long texts, dealt out over the cores where it is one small file."""
    return spread(table(spark, d, name))


def one_case(row: str):
    """One case for all rows. Read off a column, so that joins on the case keep their key."""
    return F.when(F.col(row).isNotNull(), "corpus").alias("case_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one chunk of one corpus."""
    return text_table(spark, d, "documents").select(
        one_case("doc_id"), "source", F.col("doc_id").cast("int").alias("page"),
        F.col("doc_id").alias("chunk_ord"), "text", "lang")


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page; a source is a document of the case."""
    return text_table(spark, d, "documents").select(
        F.col("lang").alias("case_id"), "source", F.col("doc_id").alias("page"), "text")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents per language as a case, sources as units."""
    return text_table(spark, d, "documents").select(
        F.col("lang").alias("case_id"), "source", F.col("doc_id").cast("int").alias("page"),
        F.col("doc_id").alias("chunk_ord"), "text", F.col("source").alias("unit_title"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark passages as queries."""
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), one_case("item_id"), "text")


def _sql(spark: SparkSession, d: str, sql: str) -> DataFrame:
    # the text is shared with the checker, so tables are put in as named inputs
    named = sql.replace("FROM orders o", "FROM {orders} o").replace("FROM customer", "FROM {customer}")
    return spark.sql(named, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


def stored_key(d: str) -> str:
    """Tells tables derived from one folder from those of another."""
    return hashlib.sha1(d.encode()).hexdigest()[:12]


def _stored(spark: SparkSession, d: str, name: str, sql: str) -> DataFrame:
    return written_once(lambda: _sql(spark, d, sql), spark, f"{name}-{stored_key(d)}")


def case_pages(spark: SparkSession, d: str) -> DataFrame:
    """Case-file pages, one per order, as a stored table."""
    return _stored(spark, d, "casefile", casefile.PAGES)


def case_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Case-file pages as chunks, one per page."""
    return case_pages(spark, d).withColumn("chunk_ord", F.col("page")).withColumn("unit_index", (F.col("page") % 3).cast("int"))


def persons(spark: SparkSession, d: str) -> DataFrame:
    """One person per customer, with one alias."""
    return _stored(spark, d, "persons", casefile.PERSONS).withColumn("aliases", F.array("last_name"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors; the label plays the source."""
    return table(spark, d, "embeddings").select(
        one_case("vec_id"), F.col("vec_id").alias("chunk_ord"), "embedding",
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("source"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    return (
        table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
        .select(F.col("label").cast("bigint").alias("query_id"), one_case("label"), "embedding")
    )
