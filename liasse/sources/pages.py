"""Readers of page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liasse import schemas


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", case_id: str | None = None) -> DataFrame:
    """Pages as (case_id, source, page, text).

    ``text`` reads whole files as page 1, named after the file; the case is
    the folder above unless given. parquet, orc, json and csv hold the columns.
    """
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
        parts = F.split("_f", "/")
        return raw.select(
            (F.lit(case_id) if case_id else F.url_decode(F.element_at(parts, -2))).alias("case_id"),
            F.url_decode(F.element_at(parts, -1)).alias("source"), F.lit(1).alias("page"), F.col("value").alias("text"))
    reader = spark.read
    if fmt in ("json", "csv"):
        reader = reader.schema(schemas.PAGES)
        if fmt == "csv":
            reader = reader.options(header=True, multiLine=True, escape='"')
    pages = reader.format(fmt).load(path)
    if case_id:
        pages = pages.withColumn("case_id", F.lit(case_id))
    return pages.select("case_id", "source", F.col("page").cast("int").alias("page"), "text")


def strip_markup(html):
    """Visible text of a web page: scripts, styles and tags out, entities back to characters."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/title|/article)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    # fixed values
    for name, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def pages_from_web(web: DataFrame, case_id: str = "web") -> DataFrame:
    """Web pages (page_id, url, html) as one-page documents."""
    return web.select(F.lit(case_id).alias("case_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source"),
                      F.lit(1).alias("page"), strip_markup(F.col("html")).alias("text"))
