"""Pages to chunks: anchors, identity facts and packed text with one ordinal per case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import clean_ws, pack_chunks, sentences
from liasse.operators import identity, segment
from liasse.operators.segment import DOC
from liasse.schemas import with_chunk_meta
from liasse.session import staged
from liasse.plans.ordering import capped_concat, name_block, page_block, parted_concat, running_total

CHUNK_COLUMNS = [
    "case_id", "source", "page", "chunk_ord", "local_chunk_id", "chunk_kind", "text", "doc_date",
    "doc_type", "unit_index", "unit_id", "unit_title", "unit_type", "page_start", "page_end",
    "is_unit_anchor", "is_fact",
]
_ITEM = "array<struct<kind:string,local:int,text:string>>"


def _item(kind: str, local: int, text: str):
    return F.when(
        F.col(text).isNotNull(),
        F.array(F.struct(F.lit(kind).alias("kind"), F.lit(local).alias("local"), F.col(text).alias("text"))),
    ).otherwise(F.array().cast(_ITEM))


def page_items(pages: DataFrame, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP,
               staging: str | None = None) -> DataFrame:
    """One row per page with its chunks as an array: anchor and fact on a unit's first page, then text.

    The pages with their unit numbers are staged: units, anchors, facts and chunks all read them.
    """
    numbered = staged(segment.number_units(pages), staging and f"{staging}/numbered")
    docs = segment.tag_documents(pages)
    units = staged(segment.tag_unit_type(segment.units_of(numbered).join(docs, DOC)), staging and f"{staging}/units")
    anchors = segment.unit_anchors(numbered, units).select(*DOC, "unit_index", F.col("text").alias("_anchor"))
    facts = identity.identity_facts(numbered, units).select(*DOC, "unit_index", F.col("fact").alias("_fact"))
    full = units.join(anchors, [*DOC, "unit_index"], "left").join(facts, [*DOC, "unit_index"], "left")
    opens = F.col("page") == F.col("page_start")
    packed = F.transform(
        pack_chunks(sentences(F.coalesce("text", F.lit(""))), size, overlap),
        lambda t, i: F.struct(F.lit("text").alias("kind"), i.alias("local"), t.alias("text")))
    items = F.concat(
        F.when(opens, _item("anchor", -2, "_anchor")).otherwise(F.array().cast(_ITEM)),
        F.when(opens, _item("fact", -1, "_fact")).otherwise(F.array().cast(_ITEM)),
        packed,
    )
    return numbered.join(full, [*DOC, "unit_index"]).withColumn("items", items).drop(
        "text", "title", "_anchor", "_fact")


def number_chunks(items: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Spread the page arrays into chunks with a contiguous ordinal per case.

    Ordinals are offsets of documents in their case plus offsets of pages in
    their document; no window goes over the chunks. ``base`` (case_id, n_chunks)
    continues an existing corpus.
    """
    counts = items.select(*DOC, "page", F.size("items").alias("_n"))
    per_doc = counts.groupBy(*DOC).agg(F.sum("_n").alias("_n"))
    doc_at = running_total(per_doc, ["case_id"], ["source"], F.col("_n"), name_block("source"), "_doc_at").drop("_n")
    if base is not None:
        doc_at = doc_at.join(base, "case_id", "left").withColumn(
            "_doc_at", F.col("_doc_at") + F.coalesce("n_chunks", F.lit(0))).drop("n_chunks")
    page_at = running_total(counts, DOC, ["page"], F.col("_n"), page_block("page"), "_page_at").drop("_n")
    spread = (
        items.join(page_at, [*DOC, "page"]).join(doc_at, DOC)
        .select("*", F.posexplode("items").alias("_pos", "_item"))
    )
    is_fact = F.col("_item.kind") == "fact"
    return (
        spread.withColumn("chunk_ord", (F.col("_doc_at") + F.col("_page_at") + F.col("_pos")).cast("bigint"))
        .withColumn("local_chunk_id", F.col("_item.local"))
        .withColumn("chunk_kind", F.col("_item.kind"))
        .withColumn("text", F.col("_item.text"))
        .withColumn("is_unit_anchor", F.col("_item.kind") == "anchor")
        .withColumn("is_fact", is_fact)
        .withColumn("doc_type", F.when(is_fact, "pv_identite").otherwise(F.col("doc_type")))
        .withColumn("unit_type", F.when(is_fact, "pv_identite").otherwise(F.col("unit_type")))
        .withColumn("unit_title", F.when(is_fact, F.concat("unit_title", F.lit(" — IDENTITÉ (facts)")))
                    .otherwise(F.col("unit_title")))
        .select(*CHUNK_COLUMNS)
    )


def build_chunks(pages: DataFrame, base: DataFrame | None = None, staging: str | None = None,
                 size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """Whole ingestion of pages. The packed pages are staged (under ``staging``, else in the shared
    folder), so that the counts behind the ordinals do not pack them again."""
    items = page_items(pages, size, overlap, staging)
    return number_chunks(staged(items, staging and f"{staging}/items"), base)


def page_chunks(pages: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Every page as one chunk, numbered on from ``base``; for texts that are cut already."""
    named = [c for c in CHUNK_COLUMNS if c not in ("case_id", "source", "page", "chunk_ord", "local_chunk_id", "chunk_kind", "text", "is_unit_anchor", "is_fact")]
    items = with_chunk_meta(pages).withColumn("items", _item("text", 0, "text"))
    return number_chunks(items.select("case_id", "source", "page", *named, "items"), base)


def chunk_pages(pages: DataFrame, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """Plain text chunks of pages, with place in the page only: one scan, no shuffle."""
    packed = pack_chunks(sentences(F.coalesce("text", F.lit(""))), size, overlap)
    return pages.select(
        *[c for c in pages.columns if c != "text"], F.posexplode(packed).alias("local_chunk_id", "text"))


def clean_pages(pages: DataFrame, full_nfkc: bool = False) -> DataFrame:
    """Cleaned page texts."""
    return pages.withColumn("text", clean_ws(F.col("text"), full_nfkc))


def concat_document(chunks: DataFrame, cap: int = rules.DOC_TEXT_CHARS) -> DataFrame:
    """Whole-document text from its chunks, blank line between, capped."""
    return capped_concat(chunks, DOC, ["chunk_ord"], page_block("chunk_ord", 4096), "text", cap)


def document_parts(chunks: DataFrame, size: int = rules.DOC_TEXT_CHARS) -> DataFrame:
    """Whole-document text from its chunks, nothing cut off, in parts of about ``size`` characters."""
    return parted_concat(chunks, DOC, ["chunk_ord"], page_block("chunk_ord", 4096), "text", size)
