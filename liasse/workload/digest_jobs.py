"""Contexts, histories, citations, bundles, chronology and block packing."""

from pyspark.sql import functions as F

from liasse.operators import context as C
from liasse.operators import digests as D
from liasse.operators import fusion
from liasse.workload import bindings as b
from liasse.workload import duck
from liasse.workload import retrieval_jobs as R


def _hits(spark, d):
    h = R._candidates(spark, d).filter("rank <= 36").withColumn("unit_index", (F.col("chunk_ord") % 3).cast("int"))
    h = h.withColumn("unit_title", F.concat(F.lit("Dossier "), "source")).withColumn("doc_type", F.col("lang")).withColumn(
        "doc_date", F.lit(None).cast("string")).withColumn("unit_id", F.lit(None).cast("string")).withColumn("unit_type", F.lit("note"))
    for c in ("page_start", "page_end", "local_chunk_id"):
        h = h.withColumn(c, F.lit(None).cast("int"))
    return h.withColumn("is_unit_anchor", F.col("chunk_ord") % 4 == 0).withColumn("is_fact", F.lit(False))


def unit_context(spark, d):
    c = C.build_context(fusion.group_by_unit(_hits(spark, d)), 3000)
    return c.select("query_id", "n_blocks", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def flat_context(spark, d):
    c = C.build_context_flat(_hits(spark, d), 3000)
    return c.select("query_id", "n_blocks", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def citable_context(spark, d):
    c = C.citable_context(fusion.group_by_unit(_hits(spark, d)), 6000)
    return c.select("query_id", "unit_key", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"), F.length("block").alias("n_chars"))


def source_summary(spark, d):
    s = C.source_summary(_hits(spark, d))
    return s.select("query_id", "source", "unit_index", "first_rank", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


def source_summary_pages(spark, d):
    s = C.source_summary(_hits(spark, d), by_unit=False)
    return s.select("query_id", "source", "page", "first_rank")


def _history(newest):
    def run(spark, d):
        w = C.history_window(b.text_table(spark, d, "conversations"), 500, newest)
        return w.select("conv_id", "turn", "n_tokens", F.md5("block").alias("digest"))

    return run


def history_blocks(spark, d):
    h = C.history_block(C.history_window(b.text_table(spark, d, "conversations"), 4096))
    return h.select("conv_id", "n_turns", F.length("history").alias("n_chars"))


_CITED = "concat(text, ' [source: src', turn % 20, ', chunk ', conv_id, '] et [SOURCE: src', conv_id % 20, ' , chunk ', conv_id, '] [source: src', turn % 20, ', chunk ', conv_id, ']')"


def citations(spark, d):
    answers = b.text_table(spark, d, "conversations").select("conv_id", "turn", b.one_case("conv_id"), F.expr(_CITED).alias("text"))
    return C.resolve_citations(answers, b.documents(spark, d)).select("conv_id", "turn", "cite_no", "source", "chunk_ord", "resolved")


def truncated_answers(spark, d):
    a = C.audit_answers(b.text_table(spark, d, "conversations"))
    return a.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cut_if_short").cast("int")).alias("n_cut"),
                                 F.sum(F.col("cut_unless_short").cast("int")).alias("n_cut_long"), F.sum("n_tokens").alias("n_tokens"))


def _dated(spark, d):
    return b.case_chunks(spark, d).withColumn("doc_date", F.when(F.col("page") % 5 != 0, F.concat(
        F.lit("19"), F.format_string("%02d", F.col("page") % 90 + 10), F.lit("-0"), (F.col("page") % 9 + 1).cast("string"), F.lit("-15"))))


def bundles(spark, d):
    return D.bundle_docs(_dated(spark, d)).select("case_id", "source", "doc_date", "n_pages", "n_bundled")


def bundle_order(spark, d):
    c = b.case_chunks(spark, d).withColumn("local_chunk_id", (F.col("page") % 4).cast("int"))
    return D.ordered_chunks(c).select("case_id", "source", "chunk_ord", F.col("doc_pos").cast("bigint").alias("doc_pos"))


def chronology(spark, d):
    c = D.chronology(_dated(spark, d), date_from="1930-01-01", date_to="not a date", excerpt=500)
    return c.select("case_id", "source", "doc_date", "label", "year", F.md5("excerpt").alias("digest"))


def chronology_top(spark, d):
    return D.chronology(_dated(spark, d), top_n=100, excerpt=200).select("case_id", "source", "doc_date", F.md5("excerpt").alias("digest"))


def block_pack(spark, d):
    return D.pack_blocks(b.document_chunks(spark, d), segment=64).select("case_id", "chunk_ord", "block_id")


def block_pack_tree(spark, d):
    """One case with all rows, in short segments that are put together few at a time."""
    one = b.document_chunks(spark, d).withColumn("case_id", b.one_case("chunk_ord").alias("c"))
    return D.pack_blocks(one, segment=100, fan=4).select("case_id", "chunk_ord", "block_id")


def block_groups(spark, d):
    c = b.document_chunks(spark, d)
    g = D.group_blocks(D.block_texts(c, D.pack_blocks(c)))
    return g.groupBy("case_id", "group_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_chunks").alias("n_chunks"), F.max(F.length("text")).alias("longest"))


def markdown_segments(spark, d):
    t = b.text_table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return D.split_segments(t, 1000).select("doc_id", "segment", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def monthly_rollup(spark, d):
    e = b.table(spark, d, "events").select(F.col("event_type").alias("case_id"), F.col("ts").alias("doc_date"))
    return D.monthly_rollup(e).select("case_id", "month", "n_docs", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


QUERIES = {
    "unit_context": unit_context, "flat_context": flat_context, "citable_context": citable_context, "source_summary": source_summary,
    "source_summary_pages": source_summary_pages, "history_newest": _history(True), "history_oldest": _history(False),
    "history_blocks": history_blocks, "citations": citations, "truncated_answers": truncated_answers, "bundles": bundles,
    "bundle_order": bundle_order, "chronology": chronology, "chronology_top": chronology_top, "block_pack": block_pack, "block_pack_tree": block_pack_tree,
    "block_groups": block_groups, "markdown_segments": markdown_segments, "monthly_rollup": monthly_rollup,
}

_H = f"""WITH {R._SIGNALS},
h AS (SELECT *, chunk_ord % 3 AS ui, (SELECT lang FROM documents WHERE doc_id = chunk_ord) AS lang FROM cand WHERE rank <= 36)"""
_BUDGET = """
n AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, length(t) // 4) END AS need FROM blk),
r AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY query_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n),
k AS (SELECT query_id, rk, CASE WHEN used + need <= 3000 THEN t ELSE left(t, CAST((3000 - used) * 4 AS BIGINT)) END AS t FROM r WHERE used < 3000),
c AS (SELECT query_id, count(*) AS n_blocks, """ + duck.strip("string_agg(t, chr(10) ORDER BY rk)") + """ AS c FROM k GROUP BY query_id)
SELECT query_id, n_blocks, length(c) AS n_chars, md5(c) AS digest FROM c"""


def _hist(order, sign):
    return f"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Utilisateur : ' WHEN 'assistant' THEN 'Assistant : ' ELSE 'Système : ' END AS p, {duck.strip('text')} AS c FROM conversations),
b AS (SELECT *, concat(p, c, chr(10)) AS b, greatest(1, length(concat(p, c, chr(10))) // 4) AS need FROM t WHERE c <> ''),
r AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY conv_id ORDER BY turn {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b),
k AS (SELECT conv_id, turn, CASE WHEN used + need <= 500 THEN b ELSE concat(p, right(c, greatest(500 - greatest(1, length(p) // 4), 16) * 4), chr(10)) END AS b
  FROM r WHERE used + need <= 500 {sign})
SELECT conv_id, turn, greatest(1, length(b) // 4) AS n_tokens, md5(b) AS digest FROM k"""


_DATED = f"""{duck.CASE}, dated AS (SELECT *, CASE WHEN page % 5 <> 0 THEN concat('19', lpad(CAST(page % 90 + 10 AS VARCHAR), 2, '0'), '-0', page % 9 + 1, '-15') END AS dd FROM casefile)"""

ORACLE = {
    "unit_context": f"""{_H},
g AS (SELECT query_id, source, ui, min(rank) AS rk, any_value(lang ORDER BY rank) AS dt, string_agg({duck.strip('text')}, chr(10) ORDER BY rank) FILTER (WHERE {duck.strip('text')} <> '') AS body FROM h GROUP BY query_id, source, ui),
blk AS (SELECT query_id, rk, concat('### Dossier ', source, chr(10), '(', (SELECT lang FROM h x WHERE x.query_id = g.query_id AND x.rank = g.rk), ', ', source, ')', chr(10), chr(10), body, chr(10)) AS t FROM g WHERE body <> ''),
{_BUDGET}""",
    "flat_context": f"""{_H},
blk AS (SELECT query_id, rank AS rk, concat('[source: ', source, CASE WHEN chunk_ord <> 0 THEN concat(', page: ', chunk_ord) ELSE '' END, ']', chr(10), {duck.strip('text')}, chr(10)) AS t FROM h WHERE {duck.strip('text')} <> ''),
{_BUDGET}""",
    "citable_context": f"""{_H},
p AS (SELECT query_id, source, ui, rank, chunk_ord, chunk_ord % 4 = 0 AS an, {duck.strip('text')} AS t,
  row_number() OVER (PARTITION BY query_id, source, ui, chunk_ord % 4 = 0 ORDER BY rank) AS nth FROM h),
s AS (SELECT *, length(concat('[source: ', source, ', chunk ', chunk_ord, '] page=', chunk_ord, chr(10), t, chr(10), chr(10))) AS n FROM p
  WHERE ((an AND nth = 1) OR (NOT an AND nth <= 6)) AND t <> ''),
r AS (SELECT *, sum(n) OVER (PARTITION BY query_id, source, ui ORDER BY an DESC, rank ROWS UNBOUNDED PRECEDING) AS tot FROM s),
a AS (SELECT query_id, source, ui, string_agg(chunk_ord, ',' ORDER BY an DESC, rank) AS cited, sum(n) AS n FROM r WHERE tot <= 6000 GROUP BY ALL),
u AS (SELECT DISTINCT query_id, source, ui FROM h)
SELECT query_id, concat(source, '|', ui) AS unit_key, coalesce(cited, '') AS cited,
  CAST(length(concat('=== ACTE / UNITÉ ===', chr(10), 'SOURCE: ', source, chr(10), 'UNIT_TITLE: Dossier ', source, chr(10), 'UNIT_TYPE: note', chr(10), 'UNIT_ID: ', chr(10), 'PAGES_UNIT: -', chr(10), '====================')) + coalesce(n - 1, 0) AS BIGINT) AS n_chars
FROM u LEFT JOIN a USING (query_id, source, ui)""",
    "source_summary": f"""{_H} SELECT query_id, source, ui AS unit_index, min(rank) AS first_rank, array_to_string(list_sort(list_distinct(list(chunk_ord))), ',') AS pages FROM h GROUP BY query_id, source, ui""",
    "source_summary_pages": f"""{_H} SELECT query_id, source, chunk_ord AS page, min(rank) AS first_rank FROM h GROUP BY query_id, source, chunk_ord""",
    "history_newest": _hist("DESC", "OR used = 0"),
    "history_oldest": _hist("ASC", ""),
    "history_blocks": f"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Utilisateur : ' WHEN 'assistant' THEN 'Assistant : ' ELSE 'Système : ' END AS p, {duck.strip('text')} AS c FROM conversations),
b AS (SELECT *, concat(p, c, chr(10)) AS b, greatest(1, length(concat(p, c, chr(10))) // 4) AS need FROM t WHERE c <> ''),
r AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT conv_id, count(*) AS n_turns, length({duck.strip("string_agg(b, '' ORDER BY turn)")}) AS n_chars FROM r WHERE used + need <= 4096 GROUP BY conv_id""",
    "citations": """
WITH a AS (SELECT conv_id, turn, unnest([0, 1]) AS cite_no FROM conversations),
c AS (SELECT conv_id, turn, cite_no, concat('src', CASE cite_no WHEN 0 THEN turn % 20 ELSE conv_id % 20 END) AS source, conv_id AS chunk_ord FROM a WHERE cite_no = 0 OR turn % 20 <> conv_id % 20)
SELECT c.*, EXISTS (SELECT 1 FROM documents d WHERE d.source = c.source AND d.doc_id = c.chunk_ord) AS resolved FROM c""",
    "truncated_answers": rf"""
WITH p AS (SELECT role, {duck.strip('text')} AS t FROM conversations)
SELECT role, count(*) AS n, sum(CASE WHEN length(t) < 200 THEN 1 WHEN regexp_matches(t, '[.!?»]$') THEN 0 ELSE 1 END)::BIGINT AS n_cut,
  sum(CASE WHEN t = '' THEN 1 WHEN length(t) < 200 THEN 0 WHEN regexp_matches(t, '[.!?»]$') THEN 0 ELSE 1 END)::BIGINT AS n_cut_long,
  sum(CASE WHEN t = '' THEN 0 ELSE greatest(1, length(t) // 4) END)::BIGINT AS n_tokens FROM p GROUP BY role""",
    "bundles": f"""
WITH {_DATED} SELECT case_id, source, (list(dd ORDER BY page))[1] AS doc_date, 0 AS n_pages, count(*) AS n_bundled FROM dated GROUP BY case_id, source""",
    "bundle_order": f"""
WITH {duck.CASE} SELECT case_id, source, page AS chunk_ord, row_number() OVER (PARTITION BY case_id, source ORDER BY page) - 1 AS doc_pos FROM casefile""",
    "chronology": f"""
WITH {_DATED}, g AS (SELECT case_id, source, (list(dd ORDER BY page))[1] AS doc_date, left(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (WHERE text <> ''), 500) AS ex FROM dated GROUP BY ALL)
SELECT case_id, source, doc_date, 'Document' AS label, left(coalesce(doc_date, '9999'), 4) AS year, md5(ex) AS digest FROM g WHERE doc_date IS NULL OR doc_date >= '1930-01-01'""",
    "chronology_top": f"""
WITH {_DATED}, g AS (SELECT case_id, source, (list(dd ORDER BY page))[1] AS doc_date, left(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (WHERE text <> ''), 200) AS ex FROM dated GROUP BY ALL)
SELECT case_id, source, doc_date, md5(ex) AS digest FROM g ORDER BY doc_date NULLS LAST, source, case_id LIMIT 100""",
    "block_pack": f"""
WITH RECURSIVE t AS (SELECT lang, doc_id, length({duck.strip('text')}) + 2 AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE {duck.strip('text')} <> ''),
p AS (SELECT lang, doc_id, i, n AS cur, 0 AS block_id FROM t WHERE i = 1
  UNION ALL SELECT t.lang, t.doc_id, t.i, CASE WHEN p.cur + t.n > 8000 THEN t.n ELSE p.cur + t.n END, CASE WHEN p.cur + t.n > 8000 THEN p.block_id + 1 ELSE p.block_id END
  FROM p JOIN t ON t.lang = p.lang AND t.i = p.i + 1)
SELECT lang AS case_id, doc_id AS chunk_ord, block_id FROM p""",
    "block_pack_tree": f"""
WITH RECURSIVE t AS (SELECT 'corpus' AS lang, doc_id, length({duck.strip('text')}) + 2 AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE {duck.strip('text')} <> ''),
p AS (SELECT lang, doc_id, i, n AS cur, 0 AS block_id FROM t WHERE i = 1
  UNION ALL SELECT t.lang, t.doc_id, t.i, CASE WHEN p.cur + t.n > 8000 THEN t.n ELSE p.cur + t.n END, CASE WHEN p.cur + t.n > 8000 THEN p.block_id + 1 ELSE p.block_id END
  FROM p JOIN t ON t.lang = p.lang AND t.i = p.i + 1)
SELECT lang AS case_id, doc_id AS chunk_ord, block_id FROM p""",
    "block_groups": f"""
WITH RECURSIVE t AS (SELECT lang, doc_id, length({duck.strip('text')}) + 2 AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE {duck.strip('text')} <> ''),
p AS (SELECT lang, doc_id, i, n, n AS cur, 0 AS block_id FROM t WHERE i = 1
  UNION ALL SELECT t.lang, t.doc_id, t.i, t.n, CASE WHEN p.cur + t.n > 8000 THEN t.n ELSE p.cur + t.n END, CASE WHEN p.cur + t.n > 8000 THEN p.block_id + 1 ELSE p.block_id END
  FROM p JOIN t ON t.lang = p.lang AND t.i = p.i + 1),
b AS (SELECT lang, block_id, count(*) AS c, CAST(sum(n) - 2 AS BIGINT) AS len FROM p GROUP BY ALL)
SELECT lang AS case_id, block_id // 5 AS group_id, count(*) AS n_blocks, CAST(sum(c) AS BIGINT) AS n_chunks, max(len) AS longest FROM b GROUP BY ALL""",
    "markdown_segments": f"""
WITH RECURSIVE s AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, concat(unnest(ps), chr(10), chr(10)) AS t FROM (
  SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents)),
p AS (SELECT doc_id, i, t AS cur, 0 AS k, CAST(NULL AS VARCHAR) AS done FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN length(p.cur) + length(s.t) > 1000 THEN s.t ELSE concat(p.cur, s.t) END,
    CASE WHEN length(p.cur) + length(s.t) > 1000 THEN p.k + 1 ELSE p.k END, CASE WHEN length(p.cur) + length(s.t) > 1000 THEN p.cur END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
o AS (SELECT doc_id, k - 1 AS k, done AS t FROM p WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(k), arg_max(cur, i) FROM p GROUP BY doc_id),
f AS (SELECT doc_id, k, {duck.strip('t')} AS t FROM o WHERE {duck.strip('t')} <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS segment, length(t) AS n_chars, md5(t) AS digest FROM f""",
    "monthly_rollup": """
SELECT event_type AS case_id, strftime(ts, '%Y-%m') AS month, count(*) AS n_docs, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day
FROM events GROUP BY ALL""",
}
