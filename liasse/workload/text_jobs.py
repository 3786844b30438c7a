"""Text cleaning, sentences, chunk packing, answer audits."""

from pyspark.sql import functions as F

from liasse.functions import text as T
from liasse.operators import chunking, context
from liasse.workload import bindings as b
from liasse.workload import duck


def _sha(col):
    return F.md5(col)


def text_clean(spark, d):
    df = chunking.clean_pages(b.document_pages(spark, d)).select("page", "source", "text")
    return df.select(F.col("page").alias("doc_id"), F.length("text").alias("n_chars"), _sha(F.col("text")).alias("digest"),
                     F.md5(T.clean_value(F.col("text"))).alias("value_digest"))


def norm_tokens(spark, d):
    t = b.text_table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def sentence_stats(spark, d):
    s = b.text_table(spark, d, "documents").withColumn("s", T.sentences(F.col("text")))
    return s.select("doc_id", F.size("s").alias("n_sentences"),
                    F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"),
                    F.md5(F.array_join("s", "|")).alias("digest"))


def sentences_wrapped(spark, d):
    s = b.text_table(spark, d, "documents").withColumn("s", T.sentences_wrapped(F.col("text")))
    return s.select("doc_id", F.posexplode("s").alias("i", "s")).select(
        "doc_id", "i", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


def chunk_pack(spark, d):
    c = chunking.chunk_pages(b.document_pages(spark, d))
    return c.select(F.col("page").alias("doc_id"), "local_chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def text_columns(spark, d):
    t = b.text_table(spark, d, "documents")
    return t.select(
        "doc_id", F.md5(T.embed_prefix(F.col("text"), "passage")).alias("passage_digest"),
        T.approx_tokens(F.col("text")).alias("n_tokens"),
        F.length(T.truncate_tokens(F.col("text"), F.lit(50))).alias("cut_chars"),
        T.citation(F.col("source"), F.col("n_chars")).alias("cite"),
        T.sha1_unit_id(F.col("source"), F.lit(0), F.col("doc_id"), F.col("n_chars"), F.col("lang")).alias("unit_id"),
        F.md5(T.fix_ocr(F.concat(F.lit("N0M D0MICILE "), "text"))).alias("ocr_digest"))


_ANSWER = """CASE turn % 4
 WHEN 1 THEN concat('```markdown\n', text, '\n```')
 WHEN 2 THEN concat('Voici : {"adresse_principale": "', length(text), ' rue A"} fin -')
 WHEN 3 THEN concat(text, ' :') ELSE text END"""


def answer_audit(spark, d):
    t = b.text_table(spark, d, "conversations").withColumn("text", F.expr(_ANSWER.replace("\n'", "\\n'").replace("'\n", "'\\n")))
    a = context.audit_answers(t)
    return a.select("conv_id", "turn", F.length("plain").alias("n_plain"), "cut_if_short", "cut_unless_short",
                    F.col("json.adresse_principale").alias("address"), F.md5("safe").alias("safe_digest"), "n_tokens")


def alias_lists(spark, d):
    p = b.persons(spark, d)
    raw = F.concat("name", F.lit("; "), F.col("last_name"), F.lit(" | "), F.lower("last_name"), F.lit(", le "), "source", F.lit("//"))
    return p.select("person_id", F.array_join(T.alias_array(raw, F.col("name")), "|").alias("aliases"))


def document_texts(spark, d):
    doc = chunking.concat_document(b.document_chunks(spark, d).drop("unit_title"), 60_000)
    return doc.select("case_id", "source", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def document_parts(spark, d):
    """The same texts whole, in parts."""
    doc = chunking.document_parts(b.document_chunks(spark, d).drop("unit_title"), 60_000)
    return doc.select("case_id", "source", "part", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES = {
    "document_parts": document_parts,
    "text_clean": text_clean,
    "norm_tokens": norm_tokens,
    "sentence_stats": sentence_stats,
    "sentences_wrapped": sentences_wrapped,
    "chunk_pack": chunk_pack,
    "text_columns": text_columns,
    "answer_audit": answer_audit,
    "alias_lists": alias_lists,
    "document_texts": document_texts,
}

_DOCS_SRC = "src AS (SELECT doc_id AS id, text FROM documents)"

ORACLE = {
    "text_clean": f"""
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest, md5(rtrim(left(t, 450))) AS value_digest
FROM (SELECT doc_id, {duck.clean('text')} AS t FROM documents)""",
    "norm_tokens": f"""
SELECT token, count(*) AS n FROM (SELECT unnest({duck.tokens('text')}) AS token FROM documents) GROUP BY token""",
    "sentence_stats": f"""
WITH {_DOCS_SRC}, {duck.SENTENCES}
SELECT d.doc_id, count(i) AS n_sentences, coalesce(max(length(s)), 0) AS longest,
  md5(coalesce(string_agg(s, '|' ORDER BY i), '')) AS digest
FROM documents d LEFT JOIN sent ON sent.id = d.doc_id GROUP BY d.doc_id""",
    "sentences_wrapped": rf"""
WITH RECURSIVE part AS (
  SELECT doc_id, generate_subscripts(ps, 1) AS i, trim(unnest(ps)) AS p FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents)),
cut AS (
  SELECT doc_id, i, 0 AS j, CAST(NULL AS VARCHAR) AS s, p AS rest FROM part WHERE p <> ''
  UNION ALL
  SELECT doc_id, i, j + 1,
    CASE WHEN c >= 120 THEN trim(left(rest, c)) ELSE rest END, CASE WHEN c >= 120 THEN trim(substr(rest, c + 1)) ELSE '' END
  FROM (SELECT *, CASE WHEN length(rest) > 300 AND contains(left(rest, 300), ' ')
                       THEN 300 - strpos(reverse(left(rest, 300)), ' ') ELSE 0 END AS c FROM cut) WHERE rest <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS i, length(s) AS n_chars, md5(s) AS digest
FROM cut WHERE s IS NOT NULL""",
    "chunk_pack": f"""
WITH RECURSIVE {_DOCS_SRC}, {duck.SENTENCES}, {duck.PACKED}
SELECT id AS doc_id, k AS local_chunk_id, length(text) AS n_chars, md5(text) AS digest FROM chunk""",
    "text_columns": f"""
SELECT doc_id,
  md5(CASE WHEN starts_with({duck.fold('text')}, 'passage:') THEN text ELSE trim(concat('passage: ', text)) END) AS passage_digest,
  CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS n_tokens,
  length(left(text, 200)) AS cut_chars, concat(source, ' p.', n_chars) AS cite,
  sha1(concat(source, '|u0|p', doc_id, '-', n_chars, '|', lang)) AS unit_id, md5(concat('NOM DOMICILE ', text)) AS ocr_digest
FROM documents""",
    "answer_audit": rf"""
WITH a AS (SELECT conv_id, turn, {_ANSWER} AS text FROM conversations),
f AS (SELECT *, {duck.strip('text')} AS bare FROM a),
p AS (SELECT *, CASE WHEN starts_with(bare, '```') THEN {duck.strip("replace(replace(bare, '```markdown', ''), '```', '')")} ELSE bare END AS plain FROM f),
t AS (SELECT *, regexp_replace(plain, '\s+$', '') AS tail FROM p)
SELECT conv_id, turn, length(plain) AS n_plain,
  CASE WHEN plain = '' THEN true WHEN length(plain) < 200 THEN true ELSE NOT regexp_matches(tail, '[.!?»]$') END AS cut_if_short,
  CASE WHEN plain = '' THEN true WHEN length(plain) < 200 THEN false ELSE NOT regexp_matches(tail, '[.!?»]$') END AS cut_unless_short,
  nullif(regexp_extract(plain, '"adresse_principale": "([^"]*)"', 1), '') AS address,
  md5(replace(replace(replace(replace(replace(plain, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS safe_digest,
  CASE WHEN plain = '' THEN 0 ELSE greatest(1, length(plain) // 4) END AS n_tokens
FROM t""",
    "alias_lists": f"""
WITH {duck.PERSONS}
SELECT person_id, concat(last_name, '|le ', source) AS aliases FROM persons""",
    "document_parts": """
SELECT case_id, source, part, length(t) AS n_chars, md5(t) AS digest FROM (
  SELECT lang AS case_id, source, (begins // 60000)::BIGINT AS part, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM (
    SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM documents WHERE length(text) > 0) GROUP BY ALL)""",
    "document_texts": """
SELECT lang AS case_id, source, length(t) AS n_chars, md5(t) AS digest FROM (
  SELECT lang, source, left(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 60000) AS t
  FROM documents WHERE length(text) > 0 GROUP BY lang, source)""",
}
