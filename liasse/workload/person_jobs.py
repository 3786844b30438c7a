"""Persons, evidence and timelines over the case files."""

from pyspark.sql import functions as F

from liasse import rules
from liasse.operators import entities as E
from liasse.operators import evidence as V
from liasse.operators import persons as P
from liasse.plans.profile import person_profile
from liasse.plans.search import hybrid_search
from liasse.workload import bindings as b
from liasse.workload import duck


def mentions(spark, d):
    return P.mentions(b.case_chunks(spark, d), b.persons(spark, d)).select("person_id", "case_id", "chunk_ord")


def mentions_words(spark, d):
    """The same through the join for person sets too large to broadcast."""
    return P.mentions(b.case_chunks(spark, d), b.persons(spark, d), small=False).select("person_id", "case_id", "chunk_ord")


def _snips(kind, limit):
    def run(spark, d):
        got = getattr(P, kind)(b.case_chunks(spark, d), b.persons(spark, d), limit)
        return got.select("person_id", "chunk_ord", "score", "rank")

    return run


def fallback_snippets(spark, d):
    """Civil snippets where a person has a strong one, else search hits in the person's case."""
    chunks, who = b.case_chunks(spark, d), b.persons(spark, d)
    civil = P.civil_snippets(chunks, who)
    return P.with_fallback(civil, who, lambda q: hybrid_search(chunks, q), rules.CIVIL_QUERY, 30, 40, min_score=8).groupBy(
        "person_id", "from_search").agg(F.count(F.lit(1)).alias("n"))


def _evidence(spark, d):
    snips = P.global_snippets(b.case_chunks(spark, d), b.persons(spark, d))
    return V.dedup_evidence(V.classify_evidence(snips))


def evidence_rows(spark, d):
    return _evidence(spark, d).select("person_id", "family", "category", "chunk_ord", "evidence_rank")


def evidence_counts(spark, d):
    return V.evidence_stats(_evidence(spark, d))


def birth_info(spark, d):
    return P.birth_info(P.civil_snippets(b.case_chunks(spark, d), b.persons(spark, d))).select("person_id", "birth_date", "birth_place")


def address_vote(spark, d):
    v = P.address_vote(P.address_snippets(b.case_chunks(spark, d), b.persons(spark, d)))
    return v.select("person_id", "main_address", "n_votes", F.array_join("other_addresses", "|").alias("others"), F.size("places").alias("n_places"))


def _classified(spark, d):
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone", "iban", "plate", "ip", "email"])
    return V.classify_occurrences(E.unique_occurrences(E.link_person(occ, b.persons(spark, d)), ["person_id"]))


def charge_classes(spark, d):
    return _classified(spark, d).select("person_id", "kind", "value", "chunk_ord", "base_class", "bucket", "class")


def bucket_summary(spark, d):
    return V.bucket_summary(_classified(spark, d)).select("case_id", "person_id", "bucket", "label", "status", F.size("refs").alias("n_refs"))


def fact_timeline(spark, d):
    return V.fact_timeline(_classified(spark, d)).select("person_id", "kind", "value", "chunk_ord", "event_date", F.col("event_ts").cast("string").alias("event_ts"))


def _sentence_rows(limit):
    def run(spark, d):
        rows, _ = V.sentence_analysis(b.case_chunks(spark, d), b.persons(spark, d), row_limit=limit)
        return rows.select("person_id", "row", "chunk_ord", "status", F.md5("label").alias("digest"))
    return run


def _sentence_events(limit):
    def run(spark, d):
        _, events = V.sentence_analysis(b.case_chunks(spark, d), b.persons(spark, d), event_limit=limit)
        return events.select("person_id", "row", "date", "kind", F.md5("event").alias("digest"))
    return run


def profiles(spark, d):
    p = person_profile(b.case_chunks(spark, d), b.persons(spark, d))
    return p.select("person_id", "name", "n_civil", "n_global", "gav", "ecoutes", "adn", "audition", "birth_date", "birth_place", "main_address", "n_technical")


QUERIES = {
    "mentions": mentions, "mentions_words": mentions_words, "civil_snippets": _snips("civil_snippets", 40),
    "global_snippets": _snips("global_snippets", 80), "address_snippets": _snips("address_snippets", 20),
    "fallback_snippets": fallback_snippets, "evidence_rows": evidence_rows, "evidence_counts": evidence_counts,
    "birth_info": birth_info, "address_vote": address_vote, "charge_classes": charge_classes, "bucket_summary": bucket_summary,
    "fact_timeline": fact_timeline, "sentence_rows": _sentence_rows(40), "sentence_events": _sentence_events(120),
    "sentence_rows_all": _sentence_rows(None), "sentence_events_all": _sentence_events(None), "person_profiles": profiles,
}


def _w(p):
    """Whole word, for ASCII words on folded text."""
    return rf"\b{p}\b"


_M = f"""
fold AS (SELECT case_id, source, page, text, {duck.fold('text')} AS f FROM casefile),
who AS (SELECT person_id, case_id, name, {duck.fold("split_part(name, ' ', 1)")} AS fn, {duck.fold('last_name')} AS ln FROM persons),
men AS (SELECT person_id, fold.* FROM fold JOIN who USING (case_id) WHERE contains(f, ln) AND regexp_matches(f, concat('\\b', ln, '\\b')))"""
# the alias is the last name, so a mention is the last name as a word


def _count(patterns):
    return " + ".join("CAST(regexp_matches(f, '{}') AS INT)".format(p.replace("(?iU)", "")) for p in patterns)


_CIV, _PROC, _ADR = _count(rules.CIVIL), _count(rules.PROCEDURAL), _count(rules.ADDRESS)
_AUD = f"CAST({duck.has_any('f', rules.AUDITION)} AS INT)"


def _ranked(src, limit):
    return f"""SELECT person_id, page AS chunk_ord, CAST(score AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY person_id, case_id ORDER BY score DESC, page) AS rank FROM {src} QUALIFY rank <= {limit}"""


_CIVIL_SC = f"""
civ AS (SELECT *, 4 * ({_CIV}) + 8 * {_AUD} - 3 * ({_PROC}) + CAST(length(f) > 80 AND length(f) < 900 AS INT) AS score FROM men),
near AS (SELECT person_id, case_id, unnest([page - 1, page + 1]) AS page, score - 1 AS score FROM civ WHERE {_AUD} = 1),
civbest AS (SELECT person_id, case_id, page, max(score) AS score FROM (
  SELECT person_id, case_id, page, score FROM civ UNION ALL SELECT n.* FROM near n JOIN casefile c USING (case_id, page)) GROUP BY ALL)"""
_GLOBAL_SC = f"""
glo AS (SELECT *, 2 * ({_CIV}) + 3 * {_AUD} + 2 * ({_PROC}) + CAST(length(f) > 80 AND length(f) < 1200 AS INT) AS score FROM men)"""
_ADDR_SC = f"""
adr AS (SELECT *, 8 * ({_ADR}) + 4 * CAST(regexp_matches(f, 'ne le|nee le') AS INT) + 2 * ({_CIV}) - ({_PROC})
  + CAST(length(f) > 50 AND length(f) < 900 AS INT) AS score FROM men WHERE ({_ADR}) > 0)"""
_HEAD = f"WITH {duck.CASE}, {duck.PERSONS}, {_M}"

_CATS = [(fam, cat, terms) for fam, cats in rules.EVIDENCE.items() for cat, terms in cats.items()]
_EV = f"""
{_GLOBAL_SC},
top AS (SELECT *, row_number() OVER (PARTITION BY person_id, case_id ORDER BY score DESC, page) AS rank FROM glo),
ev AS ({" UNION ALL ".join(f"SELECT person_id, case_id, page, rank, '{fam}' AS family, '{cat}' AS category, {i} AS pl FROM top WHERE {duck.has_any('f', terms)}"
  for i, (fam, cat, terms) in enumerate(_CATS))}),
dd AS (SELECT *, row_number() OVER (PARTITION BY person_id, case_id, family ORDER BY rank, pl) AS evidence_rank FROM (
  SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY person_id, case_id, category, page % 3, page ORDER BY rank) = 1))"""

from liasse.workload.entity_jobs import _E164, _EMAIL, _IBAN, _IP, _PHONE, _PLATE, _SNIP, _WIN, _spans  # noqa: E402

_BK = "CASE " + " ".join(f"WHEN regexp_matches(t, '{o.replace(chr(39), chr(39) * 2)}') OR regexp_matches(t, '{c.replace(chr(39), chr(39) * 2)}') THEN '{n}'"
                         for n, _, c, o in rules.BUCKETS) + " END"
_FC = "CASE " + " ".join(f"WHEN regexp_matches(t, '{o.replace(chr(39), chr(39) * 2)}') THEN 'decharge' WHEN regexp_matches(t, '{c.replace(chr(39), chr(39) * 2)}') THEN 'charge'"
                         for n, _, c, o in rules.BUCKETS) + " END"
_SN = f"CASE WHEN length(sn) > 280 THEN concat(left(sn, 280), '…') ELSE sn END"
_CLS = f"""
WITH {duck.CASE}, {duck.PERSONS},
o AS ({" UNION ALL ".join(_spans('casefile', 'case_id, source, page, text', p, k) for k, p in [('phone', _PHONE), ('iban', _IBAN), ('plate', _PLATE), ('ip', _IP), ('email', _EMAIL)])}),
v AS (SELECT *, CASE kind WHEN 'phone' THEN {_E164} WHEN 'email' THEN lower(raw) ELSE raw END AS value, {_WIN} AS near, {duck.clean(_SNIP)} AS sn FROM o),
l AS (SELECT v.*, person_id, {_SN} AS snippet FROM v JOIN (SELECT person_id, case_id, name FROM persons) USING (case_id) WHERE contains(near, lower(name))
  QUALIFY row_number() OVER (PARTITION BY person_id, kind, value, source, page ORDER BY start) = 1),
c AS (SELECT *, {duck.fold('snippet')} AS t, count(*) OVER (PARTITION BY person_id, case_id, kind, value) AS nl FROM l),
k AS (SELECT *, CASE WHEN kind = 'phone' AND (regexp_matches(t, '{rules.PHONE_USE}') OR nl >= 2) THEN 'charge' ELSE 'neutre' END AS base_class, {_BK} AS bucket, {_FC} AS fc FROM c)"""
_LABELS = "CASE bucket " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label, _, _ in rules.BUCKETS) + " END"
_MON = "(janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)"
_MLIST = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"

_SENT = rf"""
part AS (SELECT case_id, source, page, generate_subscripts(ps, 1) AS i, trim(unnest(ps)) AS p FROM (
    SELECT case_id, source, page, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM casefile)),
cut AS (
  SELECT case_id, source, page, i, 0 AS j, CAST(NULL AS VARCHAR) AS s, p AS rest FROM part WHERE p <> ''
  UNION ALL
  SELECT case_id, source, page, i, j + 1, CASE WHEN c >= 120 THEN trim(left(rest, c)) ELSE rest END, CASE WHEN c >= 120 THEN trim(substr(rest, c + 1)) ELSE '' END
  FROM (SELECT *, CASE WHEN length(rest) > 300 AND contains(left(rest, 300), ' ')
                       THEN 300 - strpos(reverse(left(rest, 300)), ' ') ELSE 0 END AS c FROM cut) WHERE rest <> ''),
st AS (SELECT case_id, source, page, row_number() OVER (PARTITION BY case_id, source, page ORDER BY i, j) - 1 AS n, s, {duck.fold('s')} AS f FROM cut WHERE s IS NOT NULL),
ps AS (SELECT DISTINCT person_id, st.*, CASE WHEN {duck.has_any('lower(s)', rules.SENTENCE_CHARGE)} THEN 'charge' WHEN {duck.has_any('lower(s)', rules.SENTENCE_DISCHARGE)} THEN 'decharge' ELSE 'neutre' END AS kind,
  coalesce(nullif(regexp_extract(s, '(\d{{1,2}} {_MON} \d{{4}})', 1), ''), nullif(regexp_extract(s, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), ''), nullif(regexp_extract(s, '\b(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})\b', 1), '')) AS date
  FROM st JOIN persons USING (case_id) WHERE contains(f, {duck.fold('last_name')}))"""

ORACLE = {
    "mentions": f"{_HEAD} SELECT person_id, case_id, page AS chunk_ord FROM men",
    "mentions_words": f"{_HEAD} SELECT person_id, case_id, page AS chunk_ord FROM men",
    "civil_snippets": f"{_HEAD}, {_CIVIL_SC} {_ranked('civbest', 40)}",
    "global_snippets": f"{_HEAD}, {_GLOBAL_SC} {_ranked('glo', 80)}",
    "address_snippets": f"{_HEAD}, {_ADDR_SC} {_ranked('(SELECT * FROM adr WHERE score > 0)', 20)}",
    "evidence_rows": f"{_HEAD}, {_EV} SELECT person_id, family, category, page AS chunk_ord, evidence_rank FROM dd",
    "evidence_counts": f"{_HEAD}, {_EV} SELECT person_id, case_id, {', '.join(f'sum(CAST(category = {chr(39)}{c}{chr(39)} AS INT))::BIGINT AS {c}' for _, c, _ in _CATS)} FROM dd GROUP BY ALL",
    "birth_info": rf"""{_HEAD}, {_CIVIL_SC},
sn AS (SELECT person_id, b.page, row_number() OVER (PARTITION BY person_id, case_id ORDER BY score DESC, b.page) AS rank, text FROM civbest b JOIN casefile USING (case_id, page)),
bi AS (SELECT person_id, rank, nullif(regexp_extract(text, 'né le ((?:\d{{1,2}}/\d{{1,2}}/\d{{4}})|(?:\d{{1,2}} \w+ \d{{4}}))', 1), '') AS d,
  nullif(rtrim(regexp_extract(text, 'né le .+? à ([A-Za-zéèêàâîôûùçÉ][^,;\n]+)', 1), ' .'), '') AS p FROM sn)
SELECT person_id, arg_min(d, rank) FILTER (WHERE d IS NOT NULL) AS birth_date, arg_min(p, rank) FILTER (WHERE p IS NOT NULL) AS birth_place FROM bi
GROUP BY person_id HAVING birth_date IS NOT NULL OR birth_place IS NOT NULL""",
    "address_vote": rf"""{_HEAD}, {_ADDR_SC},
sn AS (SELECT person_id, page, source, row_number() OVER (PARTITION BY person_id, case_id ORDER BY score DESC, page) AS rank, replace(text, chr(10), ' ') AS t FROM adr WHERE score > 0),
ca AS (SELECT person_id, rank, concat(source, ' p.', page) AS cite, trim(unnest(regexp_extract_all(t, '(?:domicilié|demeurant|résidant) (?:au|à|chez) [^.;]+'))) AS a FROM sn),
vo AS (SELECT person_id, lower(a) AS k, count(*) AS n, min(rank) AS r, arg_min(a, rank) AS a, list_sort(list_distinct(list(cite))) AS cs FROM ca GROUP BY ALL),
be AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, r) AS o FROM vo)
SELECT person_id, max(a) FILTER (WHERE o = 1) AS main_address, max(n) FILTER (WHERE o = 1) AS n_votes,
  coalesce(string_agg(a, '|' ORDER BY a) FILTER (WHERE o > 1), '') AS others,
  least(10, len(list_distinct(flatten(list(CASE WHEN o = 1 THEN cs[1:3] ELSE cs[1:2] END))))) AS n_places FROM be GROUP BY person_id""",
    "charge_classes": f"{_CLS} SELECT person_id, kind, value, page AS chunk_ord, base_class, bucket, coalesce(fc, base_class) AS class FROM k",
    "bucket_summary": f"""{_CLS},
b AS (SELECT case_id, person_id, bucket, coalesce(fc, base_class) AS class, count(*) AS n FROM k WHERE bucket IS NOT NULL GROUP BY ALL)
SELECT case_id, person_id, bucket, {_LABELS} AS label, CASE WHEN max(CAST(class = 'charge' AS INT)) = 1 THEN 'À charge' WHEN max(CAST(class = 'decharge' AS INT)) = 1 THEN 'À décharge' ELSE 'Indéterminé' END AS status,
  CAST(least(2, arg_min(n, CASE class WHEN 'charge' THEN 0 WHEN 'decharge' THEN 1 ELSE 2 END)) AS INT) AS n_refs FROM b GROUP BY case_id, person_id, bucket""",
    "fact_timeline": rf"""{_CLS},
e AS (SELECT *, regexp_extract(snippet, '\b(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\b', ['d','m','y']) AS a, regexp_extract(snippet, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') AS b,
  regexp_extract(snippet, '(\d{{1,2}}) {_MON} (\d{{4}})', ['d','m','y']) AS w, regexp_extract(snippet, '\b([01]?\d|2[0-3])h([0-5]\d)?\b', ['h','m']) AS hm
  FROM k WHERE NOT {duck.has_any('t', rules.PROCEDURE_HINTS)}),
g AS (SELECT *, CASE WHEN a.d <> '' THEN concat(a.y, '-', lpad(a.m, 2, '0'), '-', lpad(a.d, 2, '0')) WHEN b <> '' THEN b
  WHEN w.d <> '' THEN concat(w.y, '-', lpad(CAST(list_position({_MLIST}, w.m) AS VARCHAR), 2, '0'), '-', lpad(w.d, 2, '0')) END AS dd,
  CASE WHEN hm.h <> '' THEN concat(lpad(hm.h, 2, '0'), ':', CASE WHEN hm.m = '' THEN '00' ELSE hm.m END) END AS tt FROM e)
SELECT person_id, kind, value, page AS chunk_ord, CASE WHEN tt IS NOT NULL THEN concat(dd, 'T', tt) ELSE dd END AS event_date,
  concat(dd, ' ', coalesce(tt, '00:00'), ':00') AS event_ts FROM g WHERE dd IS NOT NULL""",
    "sentence_rows": f"""
WITH RECURSIVE {duck.CASE}, {duck.PERSONS}, {_SENT},
u AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY person_id, f ORDER BY page, n) = 1)
SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY page, n) AS row, page AS chunk_ord,
  CASE kind WHEN 'charge' THEN 'à charge' WHEN 'decharge' THEN 'à décharge' ELSE 'neutre' END AS status,
  md5(CASE WHEN length(s) > 220 THEN concat(left(s, 220), '…') ELSE s END) AS digest FROM u QUALIFY row <= 40""",
    "sentence_events": f"""
WITH RECURSIVE {duck.CASE}, {duck.PERSONS}, {_SENT},
u AS (SELECT * FROM ps WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id, date, f ORDER BY page, n) = 1)
SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY page, n) AS row, date, kind, md5(s) AS digest FROM u QUALIFY row <= 120""",
}
ORACLE["sentence_rows_all"] = ORACLE["sentence_rows"].replace(" QUALIFY row <= 40", "")
ORACLE["sentence_events_all"] = ORACLE["sentence_events"].replace(" QUALIFY row <= 120", "")
