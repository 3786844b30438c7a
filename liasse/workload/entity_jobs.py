"""Entity scans over documents and case files."""

from pyspark.sql import functions as F

from liasse import rules
from liasse.operators import entities as E
from liasse.workload import bindings as b
from liasse.workload import duck


def _items(df):
    return df.select("case_id", "value", "n_occurrences", "first_source", "first_chunk", F.array_join("variants", "|").alias("variants"))


def _theme(theme):
    return lambda spark, d: _items(E.scan_theme(b.document_chunks(spark, d), None, theme))


def _case_theme(theme):
    return lambda spark, d: _items(E.scan_theme(b.case_chunks(spark, d), None, theme))


def entity_spans(spark, d):
    occ = E.extract_entities(b.document_chunks(spark, d), ["email", "ip"])
    return occ.select("kind", "chunk_ord", "start", "end", "raw", "value", F.md5("snippet").alias("snippet_digest"))


def case_entity_spans(spark, d):
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone", "iban", "email", "ip", "plate", "whatsapp"])
    return occ.select("kind", "chunk_ord", "start", "raw", "value")


def linked_counts(spark, d):
    """Per number: occurrences, those near the person, and the persons near them."""
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone"])
    m = E.mark_linked(occ, b.persons(spark, d))
    return m.groupBy("case_id", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.size("linked_persons") > 0).cast("int")).alias("n_linked"))


def linked_pairs(spark, d):
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone", "plate", "iban"])
    return E.link_person(occ, b.persons(spark, d)).select("kind", "chunk_ord", "start", "value", "person_id")


def linked_pairs_grams(spark, d):
    """The same through the join for person sets too large to broadcast."""
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone", "plate", "iban"])
    return E.link_person(occ, b.persons(spark, d), small=False).select("kind", "chunk_ord", "start", "value", "person_id")


def strict_items(spark, d):
    return E.scan_theme(b.case_chunks(spark, d), b.persons(spark, d), "plaques", strict=True).select(
        "case_id", "person_id", "value", "n_occurrences", "n_linked", "first_chunk")


def phone_role_scores(spark, d):
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone"])
    s = E.score_phone_roles(E.unique_occurrences(occ), b.persons(spark, d))
    return s.select("person_id", "value", "chunk_ord", "linked", F.round("used", 4).alias("used"), F.round("contact", 4).alias("contact"), "n_rules")


def phone_roles(spark, d):
    occ = E.extract_entities(b.case_chunks(spark, d), ["phone"])
    return E.phone_roles(occ, b.persons(spark, d)).select(
        "case_id", "value", "person_id", "n_occurrences", "role", F.round("confidence", 3).alias("confidence"),
        F.size(F.coalesce("evidence", F.array().cast("array<struct<source:string,page:bigint,chunk_ord:bigint,n_rules:int,snippet:string>>"))).alias("n_evidence"))


def _numbers(spark, d):
    """Every person's number, written the national way."""
    return b.case_chunks(spark, d).select(F.regexp_extract("text", r"(06 \d\d \d\d \d\d \d\d)", 1).alias("number")).filter("number <> ''").distinct()


def phone_lookup(spark, d):
    return E.lookup_phone(b.case_chunks(spark, d), _numbers(spark, d)).select("number", "case_id", "chunk_ord", "start", "raw", F.md5("snippet").alias("snippet_digest"))


def phone_report(spark, d):
    return E.phone_report(E.lookup_phone(b.case_chunks(spark, d), _numbers(spark, d)))


def phone_report_hits(spark, d):
    return E.phone_report_hits(E.lookup_phone(b.case_chunks(spark, d), _numbers(spark, d))).select("case_id", "value", "source", "chunk_ord", "start", "occurrence")


def theme_summary(spark, d):
    occ = E.extract_entities(b.document_chunks(spark, d), ["email", "ip", "telegram"])
    return E.summarize_theme(occ, limit=40).select("case_id", "kind", "item_rank", "line")


def theme_summary_all(spark, d):
    occ = E.extract_entities(b.document_chunks(spark, d), ["email", "ip", "telegram"])
    return E.summarize_theme(occ).select("case_id", "kind", "item_rank", "line")


def technical_panel(spark, d):
    return E.technical_panel(b.case_chunks(spark, d), b.persons(spark, d)).select("case_id", "person_id", "kind", "item_rank", "value", "n_occurrences", "badge")


QUERIES = {
    "entity_emails": _theme("emails"), "entity_ips": _theme("ips"), "entity_handles": _theme("telegram"),
    "entity_spans": entity_spans, "case_entity_spans": case_entity_spans, "case_phones": _case_theme("phones"),
    "case_ibans": _case_theme("iban"), "case_plates": _case_theme("plaques"), "case_whatsapp": _case_theme("whatsapp"),
    "case_snapchat": _case_theme("snapchat"),
    "linked_counts": linked_counts, "linked_pairs": linked_pairs, "linked_pairs_grams": linked_pairs_grams, "strict_items": strict_items,
    "phone_role_scores": phone_role_scores, "phone_roles": phone_roles, "phone_lookup": phone_lookup, "phone_report": phone_report,
    "phone_report_hits": phone_report_hits, "theme_summary": theme_summary, "theme_summary_all": theme_summary_all, "technical_panel": technical_panel,
}

_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
_PHONE = r"(?:\+33 \(0\)6(?:[ .]\d{2}){4}|06(?:[ .]\d{2}){4})"
_E164 = "concat('+33', right(regexp_replace(raw, '[^0-9]', '', 'g'), 9))"


def _spans(table: str, cols: str, pattern: str, kind: str) -> str:
    """Matches with their places: each starts where the texts before it and the gaps add up to."""
    return f"""
SELECT {cols}, '{kind}' AS kind, n, raw, CAST(length(array_to_string(gaps[1:n], '')) + coalesce(length(array_to_string(ms[1:n - 1], '')), 0) AS INT) AS start
FROM (SELECT {cols}, ms, gaps, generate_subscripts(ms, 1) AS n, unnest(ms) AS raw FROM (
  SELECT {cols}, regexp_extract_all(text, '{pattern}') AS ms, string_split(regexp_replace(text, '{pattern}', chr(1), 'g'), chr(1)) AS gaps
  FROM {table}) WHERE len(ms) > 0)"""


def _item_sql(src: str, pattern: str, value: str, variant: str = "raw", table: str = "documents", case: str = "lang", ord_: str = "doc_id") -> str:
    return f"""
SELECT case_id, value, count(DISTINCT concat(source, '|', o)) AS n_occurrences, arg_min(source, o) AS first_source, min(o) AS first_chunk,
  array_to_string(list_sort(list_distinct(list(variant))), '|') AS variants
FROM (SELECT {case} AS case_id, source, {ord_} AS o, raw, {value} AS value, {variant} AS variant
      FROM (SELECT *, unnest(regexp_extract_all(text, '{pattern}')) AS raw FROM {table})) GROUP BY case_id, value"""


_CASE_ITEM = dict(table="casefile", case="case_id", ord_="page")
_WIN = "lower(substring(text, greatest(start - 80, 0) + 1, start + length(raw) + 80 - greatest(start - 80, 0)))"
_PHONE_OCC = f"""occ AS (SELECT o.*, {_E164} AS value, {_WIN} AS near FROM ({_spans('casefile', 'case_id, source, page, text', _PHONE, 'phone')}) o)"""
_IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
_PLATE = r"(?:\b[A-Z]{2}-\d{3}-[A-Z]{2}\b|\b\d{1,4}\s?[A-Z]{1,3}\s?\d{2,3}\b)"
_PAIRS = f"""
WITH {duck.CASE}, {duck.PERSONS},
o AS ({_spans('casefile', 'case_id, page, text', _PHONE, 'phone')} UNION ALL {_spans('casefile', 'case_id, page, text', _PLATE, 'plate')}
      UNION ALL {_spans('casefile', 'case_id, page, text', _IBAN, 'iban')}),
v AS (SELECT *, CASE kind WHEN 'phone' THEN {_E164} ELSE raw END AS value, {_WIN} AS near FROM o)
SELECT kind, page AS chunk_ord, start, value, person_id FROM v JOIN persons USING (case_id) WHERE contains(near, lower(name))"""
_SNIP = rf"substring(text, greatest(start - 120, 0) + 1, start + length(raw) + 120 - greatest(start - 120, 0))"
_P = "zzpersonzz"
_USED8 = [r"\bnumero(?: de(?: telephone| tel)?)?\s+de\s+{P}\b", r"\bligne\s+(?:de|au nom de)\s+{P}\b", r"\babonnement\s+(?:de|au nom de)\s+{P}\b",
          r"\battribuee?\s+a\s+{P}\b", r"\btitulaire\s*:?\s+{P}\b"]
_USED6 = [r"\b{P}\s+(?:utilise|utilisait|joignable au|contactable au)\b", r"\bau nom de\s+{P}\b", r"\bmsisdn\b.*\b{P}\b", r"\bimei\b.*\b{P}\b", r"\bimsi\b.*\b{P}\b"]
_CONT = [r"\bappele(?:e)?\s+par\s+{P}\b", r"\bcontact\s+(?:de|avec)\s+{P}\b", r"\bcorrespondant\s+de\s+{P}\b", r"\bcommunication\s+avec\s+{P}\b", r"\bconversation\s+avec\s+{P}\b"]
_WEAK = r"\bappels?\b|\bappelant\b|\bappele\b|\bcontact\b|\bconversation\b"


def _n(patterns):
    return "(" + " + ".join("CAST(regexp_matches(m, '{}') AS INT)".format(p.replace("{P}", _P)) for p in patterns) + ")"


_ROLES = f"""
WITH {duck.CASE}, {duck.PERSONS}, {_PHONE_OCC},
u AS (SELECT *, {duck.fold(_SNIP)} AS f FROM occ QUALIFY row_number() OVER (PARTITION BY case_id, value, source, page ORDER BY start) = 1),
pr AS (SELECT person_id, case_id, lower(name) AS nm, {duck.fold('name')} AS t1, {duck.fold('last_name')} AS t2 FROM persons),
pairs AS (SELECT u.*, person_id, contains(near, nm) AS linked, replace(replace(f, t1, '{_P}'), t2, '{_P}') AS m FROM u JOIN pr USING (case_id) WHERE contains(f, t1) OR contains(f, t2)),
c AS (SELECT *, {_n(_USED8)} AS a, {_n(_USED6)} AS b, {_n(_CONT)} AS k, regexp_matches(m, '{_WEAK}') AS w FROM pairs),
s AS (SELECT *, CASE WHEN linked THEN 1.0 ELSE 0.5 END * (a * 0.8 + b * 0.6 + CASE WHEN a + b + k = 0 AND w THEN 0.175 ELSE 0 END) AS used,
  CASE WHEN linked THEN 1.0 ELSE 0.5 END * (k * 0.6 + CASE WHEN a + b + k = 0 AND w THEN 0.175 ELSE 0 END) AS contact,
  a + b + k + CASE WHEN a + b + k = 0 AND w THEN 1 ELSE 0 END AS n_rules FROM c)"""

ORACLE = {
    "entity_emails": _item_sql("", _EMAIL, "lower(raw)"),
    "entity_ips": _item_sql("", _IP, "raw"),
    "entity_handles": _item_sql("", r"@[A-Za-z0-9_]{3,32}", "raw"),
    "entity_spans": f"""
SELECT kind, doc_id AS chunk_ord, start, start + length(raw) AS "end", raw, CASE kind WHEN 'email' THEN lower(raw) ELSE raw END AS value,
  md5(CASE WHEN length(sn) > 280 THEN concat(left(sn, 280), '…') ELSE sn END) AS snippet_digest
FROM (SELECT *, {duck.clean(_SNIP)} AS sn FROM ({_spans('documents', 'doc_id, text', _EMAIL, 'email')} UNION ALL {_spans('documents', 'doc_id, text', _IP, 'ip')}))""",
    "case_entity_spans": f"""
WITH {duck.CASE}
SELECT kind, page AS chunk_ord, start, raw, CASE kind WHEN 'email' THEN lower(raw) WHEN 'phone' THEN {_E164} ELSE raw END AS value FROM (
  {" UNION ALL ".join(_spans('casefile', 'page, text', p, k) for k, p in [('phone', _PHONE), ('iban', _IBAN), ('email', _EMAIL), ('ip', _IP), ('plate', _PLATE),
   ('whatsapp', '(?i)(?:wa.me|api.whatsapp.com)/(?:message/)?([A-Za-z0-9]+)')])})""",
    "case_phones": f"WITH {duck.CASE} {_item_sql('', _PHONE, _E164, **_CASE_ITEM)}",
    "case_ibans": f"WITH {duck.CASE} {_item_sql('', _IBAN, 'raw', **_CASE_ITEM)}",
    "case_plates": f"WITH {duck.CASE} {_item_sql('', _PLATE, 'raw', **_CASE_ITEM)}",
    "case_whatsapp": f"WITH {duck.CASE} {_item_sql('', 'wa.me/[A-Za-z0-9]+', 'raw', **_CASE_ITEM)}",
    "linked_counts": f"""
WITH {duck.CASE}, {duck.PERSONS}, {_PHONE_OCC}
SELECT case_id, value, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM persons p WHERE p.case_id = occ.case_id AND contains(near, lower(name))) THEN 1 ELSE 0 END)::BIGINT AS n_linked
FROM occ GROUP BY case_id, value""",
    "linked_pairs": _PAIRS,
    "linked_pairs_grams": _PAIRS,
    "strict_items": f"""
WITH {duck.CASE}, {duck.PERSONS}, v AS (SELECT *, raw AS value, {_WIN} AS near FROM ({_spans('casefile', 'case_id, source, page, text', _PLATE, 'plate')}))
SELECT case_id, person_id, value, count(DISTINCT page) AS n_occurrences, count(DISTINCT page) AS n_linked, min(page) AS first_chunk
FROM v JOIN persons USING (case_id) WHERE contains(near, lower(name)) GROUP BY ALL""",
    "phone_role_scores": f"""{_ROLES}
SELECT person_id, value, page AS chunk_ord, linked, round(used, 4) AS used, round(contact, 4) AS contact, n_rules FROM s""",
    "phone_roles": f"""{_ROLES},
base AS (SELECT case_id, value, count(*) AS n, sum(CASE WHEN regexp_matches(f, '{_WEAK}') THEN 0.0875 ELSE 0 END) AS bw FROM u GROUP BY ALL),
t AS (SELECT s.case_id, s.value, person_id, sum(used - CASE WHEN regexp_matches(f, '{_WEAK}') THEN 0.0875 ELSE 0 END) AS du,
  sum(contact - CASE WHEN regexp_matches(f, '{_WEAK}') THEN 0.0875 ELSE 0 END) AS dc, least(3, count(*) FILTER (WHERE n_rules > 0)) AS ne FROM s GROUP BY ALL),
r AS (SELECT case_id, value, person_id, n, round(bw + du, 9) AS used, round(bw + dc, 9) AS contact, ne FROM t JOIN base USING (case_id, value)
  UNION ALL SELECT case_id, value, NULL, n, round(bw, 9), round(bw, 9), 0 FROM base)
SELECT case_id, value, person_id, n AS n_occurrences,
  CASE WHEN used + contact <= 0 THEN 'unknown' WHEN used >= contact THEN 'used_by_person' ELSE 'contact_of_person' END AS role,
  CAST(round(CASE WHEN used + contact <= 0 THEN 0.3 ELSE least(0.95, greatest(0.3, greatest(used, contact) / (used + contact + 0.5))) END, 3) AS DOUBLE) AS confidence, ne AS n_evidence FROM r""",
    "phone_lookup": f"""
WITH {duck.CASE}, {_PHONE_OCC}, nums AS (SELECT DISTINCT regexp_extract(text, '(06 \\d\\d \\d\\d \\d\\d \\d\\d)', 1) AS number FROM casefile),
w AS (SELECT number, concat('+33', substr(replace(number, ' ', ''), 2)) AS value FROM nums WHERE number <> '')
SELECT number, case_id, page AS chunk_ord, start, raw, md5({duck.strip(_SNIP)}) AS snippet_digest FROM occ JOIN w USING (value)""",
    "phone_report": f"""
WITH {duck.CASE}, {_PHONE_OCC}, nums AS (SELECT DISTINCT regexp_extract(text, '(06 \\d\\d \\d\\d \\d\\d \\d\\d)', 1) AS number FROM casefile),
w AS (SELECT number, concat('+33', substr(replace(number, ' ', ''), 2)) AS value FROM nums WHERE number <> '')
SELECT case_id, value, source, count(*) AS n_hits, count(DISTINCT page) AS n_pages, min(page) AS first_page, max(page) AS last_page FROM occ JOIN w USING (value) GROUP BY ALL""",
    "phone_report_hits": f"""
WITH {duck.CASE}, {_PHONE_OCC}, nums AS (SELECT DISTINCT regexp_extract(text, '(06 \\d\\d \\d\\d \\d\\d \\d\\d)', 1) AS number FROM casefile),
w AS (SELECT number, concat('+33', substr(replace(number, ' ', ''), 2)) AS value FROM nums WHERE number <> '')
SELECT case_id, value, source, page AS chunk_ord, start, row_number() OVER (PARTITION BY case_id, value, source ORDER BY page, start) AS occurrence FROM occ JOIN w USING (value)""",
    "theme_summary": f"""
WITH o AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, lang AS case_id, source, doc_id, {v} AS value FROM (SELECT *, unnest(regexp_extract_all(text, '{p}')) AS raw FROM documents)"
  for k, p, v in [('email', _EMAIL, 'lower(raw)'), ('ip', _IP, 'raw'), ('telegram', '@[A-Za-z0-9_]{3,32}', 'raw')])}),
u AS (SELECT DISTINCT * FROM o),
i AS (SELECT case_id, kind, value, count(*) AS n, min(doc_id) AS fc, array_to_string((list(concat(source, ' p.', doc_id) ORDER BY doc_id))[1:4], ', ') AS places FROM u GROUP BY ALL)
SELECT case_id, kind, row_number() OVER (PARTITION BY case_id, kind ORDER BY n DESC, fc, value) AS item_rank,
  concat('- ', value, ' (mentionné) — ', places) AS line FROM i QUALIFY item_rank <= 40""",
}
ORACLE["theme_summary_all"] = ORACLE["theme_summary"].replace(" QUALIFY item_rank <= 40", "")
