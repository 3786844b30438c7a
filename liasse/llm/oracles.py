"""DuckDB SQL for the queries that SQL can express, for the checker."""

from __future__ import annotations

from liasse.llm import licenses, phrases, rules, secrets

_W = r"[^\x20\x09-\x0D]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {rules.BIT[name]} ELSE 0 END" for name, rule in rules.RULES.items())


OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, ({_bits()})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {rules.BASE}) <> 0 AS base_failed,
       (failed & {rules.BASE | rules.POLICIES[rules.POLICY]}) = 0 AS kept, failed, n_lines, n_upper, n_letters
FROM f"""


def _placed(name: str, pattern: str, kind: int, group: int) -> str:
    """Spans of one pattern: r, start, kind, stop, size of the group."""
    return rf"""{name} AS (
  SELECT r, t, {kind} AS kind, n AS size, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::INT AS start,
         length(hits[k]) AS len FROM (
    SELECT r, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS k, unnest(sizes) AS n FROM (
      SELECT r, t, regexp_extract_all(t, {_q(pattern)}) AS hits, string_split_regex(t, {_q(pattern)}) AS gaps,
             list_transform(regexp_extract_all(t, {_q(pattern)}, {group}), lambda x: length(x)) AS sizes FROM d)))"""


def _windows(name: str) -> str:
    pattern, symbols, bits = secrets.CLASSES[name]
    upper = "upper(piece)" if name == "hex" else "piece"
    table = "[" + ", ".join(map(str, secrets.weights())) + "]"
    allowed = "|".join(f"(?:{a})" for a in secrets.ALLOWED)
    return f"""{_placed('c_' + name, pattern, 3, 0)},
  o_{name} AS (SELECT r, start, {upper} AS piece FROM (SELECT r, start, len, substr(t, start + 1, len) AS piece FROM c_{name}) c
    WHERE NOT regexp_matches(c.piece, {_q(allowed)}) AND NOT EXISTS (
      SELECT 1 FROM base b WHERE b.r = c.r AND b.start <= c.start AND b.stop >= c.start + c.len)),
  w_{name} AS (SELECT r, start + i AS start FROM (
    SELECT r, start, i, sum({table}[n + 1]) AS s FROM (
      SELECT r, start, i, ch, count(*)::INT AS n FROM (
        SELECT r, start, i, unnest(string_split(substr(piece, i + 1, {secrets.WINDOW}), '')) AS ch FROM (
          SELECT r, start, piece, unnest(range(0, length(piece) - {secrets.WINDOW} + 1)) AS i FROM o_{name}))
      GROUP BY ALL) GROUP BY r, start, i) WHERE s <= {secrets.limit(bits)})"""


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_placed('s_assign', secrets.ASSIGN, 0, 2)},
{_placed('s_access', secrets.ACCESS, 1, 0)},
{_placed('s_hex', secrets.HEX, 2, 0)},
base AS (SELECT r, start, kind, start + len AS stop FROM (
  SELECT * FROM s_assign WHERE size >= 6 UNION ALL SELECT * FROM s_access UNION ALL SELECT * FROM s_hex)),
{_windows('hex')},
{_windows('base64')},
hot AS (SELECT r, start, start + {secrets.WINDOW} AS stop FROM w_hex UNION SELECT r, start, start + {secrets.WINDOW} FROM w_base64),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY start) AS g FROM (
  SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY r ORDER BY start) THEN 0 ELSE 1 END AS fresh FROM hot)),
extra AS (SELECT * FROM (SELECT r, min(start) AS start, 3 AS kind, max(stop) AS stop FROM isle GROUP BY r, g) e
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = e.r AND b.start <= e.start AND b.stop >= e.stop)),
every AS (SELECT r, start, kind, stop, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS w FROM (
  SELECT * FROM base UNION ALL SELECT * FROM extra)),
per AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
  string_agg(w, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(w, ',' ORDER BY start, kind) AS a FROM every GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(a, '') AS spans, coalesce(n3, 0) AS n_entropy
FROM d LEFT JOIN per USING (r)"""

_TEMPLATES = ", ".join(
    f"({_q(k)}, [{', '.join(_q(g) for g in sorted(licenses.bigrams(licenses.normal_words(t))))}])" for k, t in licenses.TEMPLATES.items())

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
tpl(name, g) AS (VALUES {_TEMPLATES}),
u AS (SELECT r, unit, list_filter(string_split(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM (
  SELECT r, unnest(list_distinct(string_split_regex(t, '\n[ \t\r]*\n') || string_split(t, chr(10)))) AS unit FROM d) WHERE length(unit) >= 3),
b AS (SELECT r, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM u WHERE len(ws) BETWEEN 2 AND 2000),
s AS (SELECT r, unit, name, 2.0 * len(list_intersect(b.g, tpl.g)) / (len(b.g) + len(tpl.g)) AS dice FROM b, tpl
      WHERE len(b.g) BETWEEN len(tpl.g) * {licenses.LEAST / (2 - licenses.LEAST)} AND len(tpl.g) * {(2 - licenses.LEAST) / licenses.LEAST}),
best AS (SELECT r, unit, min(name) AS name, any_value(dice) AS dice FROM (
  SELECT *, max(dice) OVER (PARTITION BY r, unit) AS top FROM s) WHERE dice = top AND dice >= {licenses.LEAST} GROUP BY r, unit),
per AS (SELECT r, count(*) AS n, list_sort(list_distinct(list(name))) AS names, max(dice) AS dice FROM best GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_units, coalesce(array_to_string(names, ','), '') AS licenses, round(dice, 6)::DOUBLE AS dice
FROM d LEFT JOIN per USING (r)"""

OP11 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(x, '[ \t]+'), lambda w: w <> '') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, ws[i:i + k - 1] AS g, count(*) AS f FROM (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
c AS (SELECT * FROM g WHERE k > 1 AND f >= {phrases.LEAST}),
s AS (SELECT c.lang, c.g, c.k, c.f AS a, x.f AS l, y.f AS r, cut, {phrases.SCALE}::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN g y ON y.lang = c.lang AND y.g = c.g[cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_ones AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM c WHERE k = 3),
ok AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b WHERE NOT EXISTS (
  SELECT 1 FROM inner_ones i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.f >= {phrases.CONTAINED} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ok JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}"""

_GRID = ", ".join(f"({_q(v)}, {_q(name)}, {mask}, {bit})" for v, mask in rules.POLICIES.items() for name, bit in rules.BIT.items() if mask & bit)

ABLATIONS = f"""
WITH book AS ({OP7}), p(version, rule, mask, bit) AS (VALUES {_GRID})
SELECT version, rule, count(*) FILTER ((failed & mask) = 0) AS kept, count(*) FILTER ((failed & (mask - bit)) = 0) AS kept_without,
       count(*) FILTER ((failed & mask) = bit) AS only_this
FROM p LEFT JOIN book ON true GROUP BY version, rule"""

ORACLE = {"op1_secrets": OP1, "op2_licenses": OP2, "op7_rules": OP7, "rule_ablations": ABLATIONS, "op11_phrases": OP11}
