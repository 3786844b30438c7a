"""SQL fragments of the checker, in DuckDB's words."""

from liasse.workload import casefile


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return clean(f"strip_accents(lower({x}))")


def tokens(x: str) -> str:
    return f"list_filter(string_split({fold(x)}, ' '), lambda t: t <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def has_any(x: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, w.replace("'", "''")) for w in words) + ")"


CASE = f"casefile AS ({casefile.PAGES})"
PERSONS = f"persons AS ({casefile.PERSONS})"

# sentences of `src(id, text)`, numbered
SENTENCES = rf"""
sent AS (
  SELECT id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (
    SELECT id, list_filter(list_transform(regexp_extract_all({clean('text')}, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '') AS ss
    FROM src))"""

# greedy packing of sent(id, i, s): one step per sentence, all texts side by side
PACKED = """
pack AS (
  SELECT id, i, s AS cur, length(s) + 1 AS used, 0 AS k, CAST(NULL AS VARCHAR) AS done FROM sent WHERE i = 1
  UNION ALL
  SELECT p.id, n.i,
    CASE WHEN p.used + length(n.s) > 800 THEN trim(concat(trim(right(p.cur, 120)), ' ', n.s)) ELSE concat(p.cur, ' ', n.s) END,
    CASE WHEN p.used + length(n.s) > 800 THEN length(trim(right(p.cur, 120))) ELSE p.used END + length(n.s) + 1,
    CASE WHEN p.used + length(n.s) > 800 THEN p.k + 1 ELSE p.k END,
    CASE WHEN p.used + length(n.s) > 800 THEN p.cur END
  FROM pack p JOIN sent n ON n.id = p.id AND n.i = p.i + 1),
chunk AS (
  SELECT id, k - 1 AS k, done AS text FROM pack WHERE done IS NOT NULL
  UNION ALL
  SELECT id, max(k), arg_max(cur, i) FROM pack GROUP BY id)"""
