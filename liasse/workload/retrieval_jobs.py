"""Batch search over documents with the benchmark passages as queries."""

from pyspark.sql import functions as F

from liasse.operators import dense, fusion, lexical, signals
from liasse.plans.search import hybrid_search
from liasse.session import staged
from liasse.workload import bindings as b
from liasse.workload import duck

LIMIT = 72


def phrased(spark, d):
    """Queries that name a source and quote the head of a document, one per benchmark passage."""
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "source", "text")
    items = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    words = F.array_join(F.slice(F.split(F.regexp_replace("text", r"[\s\"']+", " "), " "), 1, 4), " ")
    return items.join(docs, "query_id").select(
        "query_id", b.one_case("query_id"),
        F.concat(F.lit("liste "), "source", F.lit(' : "'), words, F.lit('" '), "passage").alias("text"))


def bm25_topk(spark, d):
    return lexical.bm25(b.documents(spark, d), b.queries(spark, d), limit=LIMIT).select("query_id", "chunk_ord", "score", "rank")


def term_weights(spark, d):
    stats = lexical.term_stats(lexical.tokenized(b.documents(spark, d)))
    return lexical.term_weights(stats).select("term", "df", "n_chunks", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


def query_params(spark, d):
    conv = b.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit("corpus").alias("case_id"),
        F.concat(F.when(F.col("turn") % 3 == 0, "Né le 3/4/1980 : ").when(F.col("turn") % 3 == 1, "Liste complète, ").otherwise(""),
                 "text").alias("text"))
    return signals.retrieval_params(conv).select(
        "query_id", "is_identity", "is_inventory", "top_k", "n_candidates", "max_per_source", "mmr_lambda")


def source_hits(spark, d):
    return signals.name_hits(b.documents(spark, d), phrased(spark, d), LIMIT).select("query_id", "chunk_ord", "score", "rank")


def phrase_hits(spark, d):
    return signals.phrase_hits(b.documents(spark, d), phrased(spark, d), LIMIT).select("query_id", "chunk_ord", "rank")


def _case_queries(spark, d):
    """One identity query per nation."""
    return b.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("case_id"),
        F.lit("Identité et filiation").alias("text"))


def identity_hits(spark, d):
    chunks = b.case_chunks(spark, d).withColumn("unit_title", F.element_at(F.split("text", "\n"), 1)).withColumn(
        "doc_type", F.when(F.col("text").contains("NOM : "), "pv_identite").otherwise("document"))
    return signals.identity_hits(chunks, _case_queries(spark, d), LIMIT).select("query_id", "chunk_ord", "score", "rank")


def fact_hits(spark, d):
    chunks = b.case_chunks(spark, d).withColumn("is_fact", F.col("text").contains("NOM : "))
    return signals.fact_hits(chunks, _case_queries(spark, d), LIMIT).select("query_id", "chunk_ord", "rank")


def dense_topk(spark, d):
    return dense.dense(b.vectors(spark, d), b.query_vectors(spark, d), LIMIT).select("query_id", "chunk_ord", "score", "rank")


def dense_topk_blocks(spark, d):
    return dense.dense(b.vectors(spark, d), b.query_vectors(spark, d), LIMIT, small=False).select("query_id", "chunk_ord", "score", "rank")


def _fused(spark, d):
    docs = b.documents(spark, d)
    q = phrased(spark, d)
    return fusion.rrf({
        "lexical": lexical.bm25(docs, q, limit=LIMIT),
        "name": signals.name_hits(docs, q, LIMIT),
        "phrase": signals.phrase_hits(docs, q, LIMIT),
    }, boosts={"name": 2})


def _candidates(spark, d):
    top = fusion.top_fused(_fused(spark, d), limit=LIMIT)
    return top.join(b.documents(spark, d), ["case_id", "chunk_ord"])


def rrf_fused(spark, d):
    return fusion.top_fused(_fused(spark, d), limit=LIMIT).select("query_id", "chunk_ord", F.round("score", 6).alias("score"), "rank")


def candidates_unique(spark, d):
    return fusion.dedup_candidates(_candidates(spark, d)).select("query_id", "chunk_ord", "rank")


def round_robin(spark, d):
    return fusion.round_robin(_candidates(spark, d)).select("query_id", "chunk_ord", "source", "rank")


def cap_per_source(spark, d):
    return fusion.cap_per_source(_candidates(spark, d), 3).select("query_id", "chunk_ord", "source", "rank")


def _params(hits):
    return hits.select("query_id", "case_id").distinct().withColumn("top_k", F.lit(12)).withColumn("max_per_source", F.lit(3))


def neighbors(spark, d):
    hits = staged(_candidates(spark, d).filter("rank <= 12").select("query_id", "case_id", "chunk_ord", "rank"))
    return fusion.expand_neighbors(hits, b.documents(spark, d), _params(hits)).select(
        "query_id", "chunk_ord", "rank")


def budget_chars(spark, d):
    return fusion.budget_chars(_candidates(spark, d), 1500, 20_000).select("query_id", "chunk_ord", F.length("text").alias("n_chars"))


def group_hits(spark, d):
    hits = _candidates(spark, d).withColumn("unit_id", F.when(F.col("chunk_ord") % 2 == 0, F.concat("source", F.lit("-even")))).withColumn(
        "unit_index", (F.col("chunk_ord") % 3).cast("int"))
    for c in ("unit_title", "unit_type", "doc_date", "doc_type"):
        hits = hits.withColumn(c, F.lit(None).cast("string"))
    for c in ("page_start", "page_end", "local_chunk_id"):
        hits = hits.withColumn(c, F.lit(None).cast("int"))
    for c in ("is_unit_anchor", "is_fact"):
        hits = hits.withColumn(c, F.lit(False))
    return fusion.group_by_unit(hits).select(
        "query_id", "unit_key", "rank", F.array_join(F.transform("chunks", lambda c: c["chunk_ord"].cast("string")), ",").alias("chunk_ords"))


def mmr_topk(spark, d):
    q, v = b.query_vectors(spark, d), b.vectors(spark, d)
    params = q.select("query_id", "case_id", F.lit(12).alias("top_k"), F.lit(0.7).alias("mmr_lambda"))
    return dense.mmr(dense.dense(v, q, LIMIT), v, q, params).select("query_id", "chunk_ord", "rank")


def refresh_vectors(spark, d):
    v = b.vectors(spark, d).withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    out = dense.refresh_embeddings(v, v, 64)
    return out.select("chunk_ord", F.size("embedding").alias("dim"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"),
        F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


def hybrid(spark, d):
    return hybrid_search(b.documents(spark, d), b.queries(spark, d)).select("query_id", "chunk_ord", "source", "rank")


def hybrid_grouped(spark, d):
    return hybrid_search(b.documents(spark, d), phrased(spark, d), shape="grouped").select(
        "query_id", "unit_key", "rank", F.size("chunks").alias("n_chunks"))


def hybrid_vectors(spark, d):
    """With vectors: documents and vectors share ordinals, every passage takes a label's vector."""
    n = F.lit(10)
    q = b.queries(spark, d)
    qv = q.join(b.query_vectors(spark, d).select(F.col("query_id").alias("_l"), "embedding"),
                F.col("query_id") % n == F.col("_l")).select("query_id", "case_id", "embedding")
    return hybrid_search(b.documents(spark, d), q, b.vectors(spark, d), qv).select("query_id", "chunk_ord", "rank")


QUERIES = {
    "bm25_topk": bm25_topk, "term_weights": term_weights, "query_params": query_params, "source_hits": source_hits,
    "phrase_hits": phrase_hits, "identity_hits": identity_hits, "fact_hits": fact_hits, "dense_topk": dense_topk,
    "dense_topk_blocks": dense_topk_blocks, "rrf_fused": rrf_fused, "candidates_unique": candidates_unique,
    "round_robin": round_robin, "cap_per_source": cap_per_source, "neighbors": neighbors, "budget_chars": budget_chars,
    "group_hits": group_hits, "mmr_topk": mmr_topk, "refresh_vectors": refresh_vectors, "hybrid_search": hybrid,
    "hybrid_grouped": hybrid_grouped, "hybrid_vectors": hybrid_vectors,
}

_STATS = f"""
tok AS (SELECT doc_id, {duck.tokens('text')} AS ts FROM documents),
size AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS avg_len FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM tok) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, n, avg_len, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, size),
mean AS MATERIALIZED (SELECT avg(r) AS m FROM raw),
w AS (SELECT term, df, n, avg_len, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, mean)"""


def _bm25(queries: str) -> str:
    return f"""{_STATS},
q AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({duck.tokens('text')}) AS term FROM q) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
       FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
       FROM qt JOIN w USING (term) JOIN tf USING (term) GROUP BY query_id, doc_id),
lexical AS (SELECT query_id, doc_id AS chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
       FROM sc QUALIFY rank <= {LIMIT})"""


_PHRASED = rf"""SELECT item_id AS query_id, concat('liste ', source, ' : "',
  array_to_string(string_split(regexp_replace(d.text, '[\s"'']+', ' ', 'g'), ' ')[1:4], ' '), '" ', b.text) AS text
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id"""

_SIGNALS = rf"""{_bm25(_PHRASED)},
qn AS (SELECT query_id, list_filter(regexp_split_to_array({duck.fold('text')}, '[^a-z0-9_.-]+'), lambda t: t <> '') AS ws FROM q),
src AS (SELECT DISTINCT source, {duck.fold('source')} AS name FROM documents),
ns AS (SELECT query_id, source, count(*) AS score FROM (SELECT query_id, unnest(ws) AS w FROM qn), src WHERE contains(name, w) GROUP BY ALL),
name AS (SELECT query_id, doc_id AS chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
       FROM ns JOIN documents USING (source) QUALIFY rank <= {LIMIT}),
ph AS (SELECT query_id, {duck.fold("trim(regexp_extract(text, '\"([^\"]{4,})\"', 1))")} AS phrase FROM q),
phrase AS (SELECT query_id, doc_id AS chunk_ord, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank
       FROM ph JOIN (SELECT doc_id, {duck.fold('text')} AS t FROM documents) ON phrase <> '' AND contains(t, phrase) QUALIFY rank <= {LIMIT}),
share AS (
  SELECT query_id, chunk_ord, 1 / (60.0 + rank) AS s FROM lexical
  UNION ALL SELECT query_id, chunk_ord, 1 / (60.0 + rank) + 1 / (60.0 + rank + count(*) OVER (PARTITION BY query_id)) FROM name
  UNION ALL SELECT query_id, chunk_ord, 1 / (60.0 + rank) FROM phrase),
fused AS (SELECT query_id, chunk_ord, round(sum(s), 9) AS score FROM share GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord) AS rank FROM fused QUALIFY rank <= {LIMIT}),
cand AS (SELECT top.*, source, text FROM top JOIN documents ON doc_id = chunk_ord)"""

_NEIGHBORS = """
seq AS (
  SELECT query_id, chunk_ord, 0 AS phase, rank * 2 AS pos FROM base
  UNION ALL SELECT query_id, chunk_ord - 1, 1, rank * 2 FROM base
  UNION ALL SELECT query_id, chunk_ord + 1, 1, rank * 2 + 1 FROM base),
uniq AS (SELECT * FROM seq QUALIFY row_number() OVER (PARTITION BY query_id, chunk_ord ORDER BY phase, pos) = 1),
capd AS (SELECT uniq.*, source FROM uniq JOIN documents ON doc_id = chunk_ord
         QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY phase, pos) <= 3),
final AS (SELECT query_id, chunk_ord, source, row_number() OVER (PARTITION BY query_id ORDER BY phase, pos) AS rank FROM capd QUALIFY rank <= 24)"""

_QV = """qv AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS e FROM (
  SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY label, i) GROUP BY label)"""
_DENSE = f"""WITH {_QV}
SELECT query_id, vec_id AS chunk_ord, round(list_inner_product(e, CAST(embedding AS DOUBLE[])), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(e, CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) AS rank
FROM qv, embeddings QUALIFY rank <= {LIMIT}"""

ORACLE = {
    "bm25_topk": f"WITH {_bm25('SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id, chunk_ord, score, rank FROM lexical",
    "term_weights": f"WITH {_STATS} SELECT term, df, n AS n_chunks, round(avg_len, 6) AS avg_len, round(idf, 6) AS idf FROM w",
    "query_params": f"""
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, {duck.fold("concat(CASE turn % 3 WHEN 0 THEN 'Né le 3/4/1980 : ' WHEN 1 THEN 'Liste complète, ' ELSE '' END, text)")} AS t FROM conversations),
c AS (SELECT query_id, {duck.has_any('t', [
    'identite', 'etat civil', 'date de naissance', 'naissance', 'ne le', 'nee le', 'nationalite', 'domicile', 'adresse', 'reside',
    'filiation', 'pere', 'mere', 'signalement', 'taille', 'poids', 'cheveux', 'yeux', 'piece d identite', 'carte nationale',
    'passeport', 'cni', 'nni', 'nom :', 'prenom :'])} AS idn,
  {duck.has_any('t', ['liste', 'recense', 'inventaire', 'exhaustif', 'tous les', 'toutes les', "l'ensemble", 'la totalite', 'global', 'complet'])} AS inv FROM q)
SELECT query_id, idn AS is_identity, inv AS is_inventory, CASE WHEN inv THEN 36 ELSE 12 END AS top_k,
  CASE WHEN inv THEN 144 ELSE 72 END AS n_candidates, CASE WHEN inv THEN 0 ELSE 3 END AS max_per_source,
  CASE WHEN inv THEN 0.85 WHEN idn THEN 0.78 ELSE 0.7 END AS mmr_lambda FROM c""",
    "source_hits": f"WITH {_SIGNALS} SELECT query_id, chunk_ord, CAST(score AS DOUBLE) AS score, rank FROM name",
    "phrase_hits": f"WITH {_SIGNALS} SELECT query_id, chunk_ord, rank FROM phrase",
    "identity_hits": f"""
WITH {duck.CASE}, c AS (SELECT case_id, page, CASE WHEN contains(text, 'NOM : ') THEN 3 ELSE 0 END
  + CASE WHEN {duck.has_any(duck.fold("split_part(text, chr(10), 1)"), ['identite', 'etat civil', 'signalement', 'filiation'])} THEN 2 ELSE 0 END
  + CASE WHEN contains(lower(source), 'identite') THEN 1 ELSE 0 END AS score FROM casefile)
SELECT n_nationkey AS query_id, page AS chunk_ord, CAST(score AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY case_id ORDER BY score DESC, page) AS rank
FROM c JOIN nation ON case_id = concat('N', n_nationkey) WHERE score > 0 QUALIFY rank <= {LIMIT}""",
    "fact_hits": f"""
WITH {duck.CASE} SELECT n_nationkey AS query_id, page AS chunk_ord, row_number() OVER (PARTITION BY case_id ORDER BY page) AS rank
FROM casefile JOIN nation ON case_id = concat('N', n_nationkey) WHERE contains(text, 'NOM : ') QUALIFY rank <= {LIMIT}""",
    "dense_topk": _DENSE,
    "dense_topk_blocks": _DENSE,
    "rrf_fused": f"WITH {_SIGNALS} SELECT query_id, chunk_ord, round(score, 6) AS score, rank FROM top",
    "candidates_unique": f"""
WITH {_SIGNALS}, f AS (SELECT query_id, chunk_ord, rank AS r, {duck.fold('text')} AS t FROM cand),
u AS (SELECT * FROM f WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY r) = 1)
SELECT query_id, chunk_ord, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM u""",
    "round_robin": f"""
WITH {_SIGNALS}, t AS (SELECT query_id, chunk_ord, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn,
  min(rank) OVER (PARTITION BY query_id, source) AS lead FROM cand)
SELECT query_id, chunk_ord, source, row_number() OVER (PARTITION BY query_id ORDER BY turn, lead) AS rank FROM t""",
    "cap_per_source": f"""
WITH {_SIGNALS}, t AS (SELECT query_id, chunk_ord, source, rank AS r FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 3)
SELECT query_id, chunk_ord, source, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM t""",
    "neighbors": f"WITH {_SIGNALS}, base AS (SELECT * FROM cand WHERE rank <= 12), {_NEIGHBORS} SELECT query_id, chunk_ord, rank FROM final",
    "budget_chars": f"""
WITH {_SIGNALS}, t AS (SELECT query_id, chunk_ord, least(length(text), 1500) AS n,
  coalesce(sum(least(length(text), 1500)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM cand)
SELECT query_id, chunk_ord, CAST(least(n, 20000 - used) AS BIGINT) AS n_chars FROM t WHERE used < 20000""",
    "group_hits": f"""
WITH {_SIGNALS}, g AS (SELECT query_id, CASE WHEN chunk_ord % 2 = 0 THEN concat(source, '-even') ELSE concat(source, '|', chunk_ord % 3) END AS unit_key,
  min(rank) AS best, string_agg(chunk_ord, ',' ORDER BY rank) AS chunk_ords FROM cand GROUP BY 1, 2)
SELECT query_id, unit_key, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank, chunk_ords FROM g""",
    "refresh_vectors": """
SELECT vec_id AS chunk_ord, len(embedding) AS dim, 1.0 AS norm,
  round(embedding[1] / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS first FROM embeddings""",
    "hybrid_search": f"""
WITH {_SIGNALS.replace(_PHRASED, 'SELECT item_id AS query_id, text FROM benchmark')},
un AS (SELECT query_id, chunk_ord, source, r FROM (SELECT query_id, chunk_ord, source, rank AS r, {duck.fold('text')} AS t FROM cand) WHERE t <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY r) = 1),
head AS (SELECT query_id, chunk_ord, source, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM un QUALIFY rank <= 12),
tl AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, source) AS lead FROM head),
base AS (SELECT query_id, chunk_ord, row_number() OVER (PARTITION BY query_id ORDER BY turn, lead) AS rank FROM tl WHERE turn <= 3),
{_NEIGHBORS}
SELECT query_id, chunk_ord, source, rank FROM final""".replace(
        "1 / (60.0 + rank) + 1 / (60.0 + rank + count(*) OVER (PARTITION BY query_id)) FROM name", "1 / (60.0 + rank) FROM name"),
}


def _grouped() -> str:
    """The fused search of the phrased queries, its hits grouped.

    They ask for lists, so limits are three times as wide and sources have no
    cap; whole documents have no units, so a source is one group.
    """
    hits = ORACLE["hybrid_search"].rsplit("SELECT query_id, chunk_ord, source, rank FROM final", 1)[0]
    for old, new in (("SELECT item_id AS query_id, text FROM benchmark", _PHRASED), (f"<= {LIMIT}", f"<= {2 * LIMIT}"), ("rank <= 24)", "rank <= 72)"),
                     ("QUALIFY rank <= 12)", "QUALIFY rank <= 36)"), ("WHERE turn <= 3)", ")"), ("ORDER BY phase, pos) <= 3)", "ORDER BY phase, pos) > 0)")):
        hits = hits.replace(old, new)
    return f"""{hits},
g AS (SELECT query_id, concat(source, '|-1') AS unit_key, min(rank) AS best, count(*)::INT AS n_chunks FROM final GROUP BY ALL)
SELECT query_id, unit_key, (row_number() OVER (PARTITION BY query_id ORDER BY best))::INT AS rank, n_chunks FROM g"""


ORACLE["hybrid_grouped"] = _grouped()
