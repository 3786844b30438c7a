"""Table layouts shared by the jobs."""

PAGES = "case_id string, source string, page int, text string"

CHUNKS = (
    "case_id string, source string, page int, chunk_ord bigint, local_chunk_id int, "
    "chunk_kind string, text string, doc_date string, doc_type string, unit_index int, "
    "unit_id string, unit_title string, unit_type string, page_start int, page_end int, "
    "is_unit_anchor boolean, is_fact boolean"
)

QUERIES = "query_id bigint, case_id string, text string, top_k int, inventory_mode boolean"

PERSONS = "person_id bigint, case_id string, name string, aliases array<string>"

#: a query is told by its id within its case
QUERY = ["query_id", "case_id"]

#: chunk columns every retrieval and person job carries along
CHUNK_KEYS = ["case_id", "chunk_ord"]

#: chunk description columns that may be missing in an older corpus, with their types
CHUNK_META = {
    "page": "int",
    "local_chunk_id": "int",
    "chunk_kind": "string",
    "doc_date": "string",
    "doc_type": "string",
    "unit_index": "int",
    "unit_id": "string",
    "unit_title": "string",
    "unit_type": "string",
    "page_start": "int",
    "page_end": "int",
    "is_unit_anchor": "boolean",
    "is_fact": "boolean",
}


def with_chunk_meta(chunks):
    """Add the chunk description columns an older corpus lacks, as typed nulls."""
    from pyspark.sql import functions as F

    for name, kind in CHUNK_META.items():
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    return chunks
