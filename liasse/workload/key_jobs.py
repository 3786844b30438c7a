"""Cases, queries and pages whose keys look alike: nothing of one case may reach another."""

from pyspark.sql import functions as F

from liasse.operators import context, lexical, segment
from liasse.operators.segment import DOC
from liasse.session import shared_dir
from liasse.sources import corpus
from liasse.workload import bindings as b
from liasse.workload import duck, segment_jobs

ALIKE = ["001", "1", "1.0", "1e3", "2021-03-12"]
LIMIT = 20


def _cases(spark, d):
    """Every document in one of five cases whose names read alike as numbers or dates."""
    names = F.array(*[F.lit(c) for c in ALIKE])
    return b.text_table(spark, d, "documents").select(
        F.element_at(names, (F.col("doc_id") % len(ALIKE) + 1).cast("int")).alias("case_id"), "source", "text",
        F.floor(F.col("doc_id") / len(ALIKE)).alias("chunk_ord"))


def _queries(spark, d):
    """Every benchmark passage as a query of the same id in each case."""
    items = b.table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), "text", F.explode(F.array(*[F.lit(c) for c in ALIKE])).alias("case_id"))


def case_names(spark, d):
    """Written to a stored corpus and read back case by case."""
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/case-names"
    corpus.write_corpus({"chunks": _cases(spark, d)}, root)
    each = [corpus.read_table(spark, root, "chunks", [c]) for c in ALIKE]
    rows = each[0]
    for df in each[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_ord").alias("first"), F.max("chunk_ord").alias("last"))


def bm25_cases(spark, d):
    """Search with query ids that recur across the cases."""
    return lexical.bm25(_cases(spark, d), _queries(spark, d), limit=LIMIT).select("query_id", "case_id", "chunk_ord", "score", "rank")


def citation_cases(spark, d):
    """Answers of several cases that cite the same ordinals and sources."""
    text = F.concat("text", F.lit(" [source: src"), (F.col("turn") % 20).cast("string"), F.lit(", chunk "), (F.col("conv_id") % 40).cast("string"), F.lit("]"))
    names = F.array(*[F.lit(c) for c in ALIKE])
    answers = b.text_table(spark, d, "conversations").select(
        "conv_id", "turn", F.element_at(names, (F.col("conv_id") % len(ALIKE) + 1).cast("int")).alias("case_id"), text.alias("text"))
    return context.resolve_citations(answers, _cases(spark, d)).select("conv_id", "turn", "case_id", "source", "chunk_ord", "resolved")


def repeated_pages(spark, d):
    """Every page of a case file twice: the numbering must not multiply them."""
    pages = b.case_pages(spark, d)
    return segment.number_units(pages.unionByName(pages)).groupBy(*DOC).agg(F.count(F.lit(1)).alias("n"), F.max("unit_index").alias("last_unit"))


QUERIES = {"case_names": case_names, "bm25_cases": bm25_cases, "citation_cases": citation_cases, "repeated_pages": repeated_pages}

_NAMES = "[" + ", ".join(f"'{c}'" for c in ALIKE) + "]"
_DOCS = f"docs AS (SELECT {_NAMES}[doc_id % {len(ALIKE)} + 1] AS case_id, source, text, doc_id // {len(ALIKE)} AS chunk_ord FROM documents)"

ORACLE = {
    "case_names": f"WITH {_DOCS} SELECT case_id, count(*) AS n, min(chunk_ord) AS first, max(chunk_ord) AS last FROM docs GROUP BY case_id",
    "bm25_cases": f"""
WITH {_DOCS}, tok AS (SELECT case_id, chunk_ord, {duck.tokens('text')} AS ts FROM docs),
size AS (SELECT case_id, count(*) AS n, sum(len(ts)) / count(*) AS avg_len FROM tok GROUP BY case_id),
df AS (SELECT case_id, term, count(*) AS df FROM (SELECT DISTINCT case_id, chunk_ord, unnest(ts) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT case_id, term, df, avg_len, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN size USING (case_id)),
mean AS (SELECT case_id, avg(r) AS m FROM raw GROUP BY case_id),
w AS (SELECT case_id, term, avg_len, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw JOIN mean USING (case_id)),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({duck.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT case_id, chunk_ord, term, count(*) AS tf, any_value(dl) AS dl
       FROM (SELECT case_id, chunk_ord, len(ts) AS dl, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
sc AS (SELECT query_id, case_id, chunk_ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
       FROM tf JOIN w USING (case_id, term) JOIN qt USING (term) GROUP BY ALL)
SELECT query_id, case_id, chunk_ord, score, row_number() OVER (PARTITION BY query_id, case_id ORDER BY score DESC, chunk_ord) AS rank
FROM sc QUALIFY rank <= {LIMIT}""",
    "citation_cases": f"""
WITH {_DOCS}, a AS (SELECT conv_id, turn, {_NAMES}[conv_id % {len(ALIKE)} + 1] AS case_id, concat('src', turn % 20) AS source, conv_id % 40 AS chunk_ord FROM conversations)
SELECT conv_id, turn, case_id, source, chunk_ord, EXISTS (SELECT 1 FROM docs d WHERE d.case_id = a.case_id AND d.source = a.source AND d.chunk_ord = a.chunk_ord) AS resolved
FROM a""",
    "repeated_pages": f"""
WITH {duck.CASE}, {segment_jobs._UNITS} SELECT case_id, source, 2 * count(*) AS n, max(unit_index) AS last_unit FROM numbered GROUP BY case_id, source""",
}
