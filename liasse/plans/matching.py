"""Which texts contain which strings, for a few, many or very many strings.

A few strings per case are packed and tested text by text. More of them are
looked up by an automaton per case, as long as their bytes are under a stated
bound. Beyond that they are found by an equi-join: substrings on the rarest
of their byte windows, names on a word, then a check of the full string. A bit
table of the keys (``keys.py``) holds back all other windows and words where
the texts are read, so only rows with a candidate are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liasse.plans import automaton
from liasse.plans import keys as filters

FEW_PER_CASE = 64
SMALL_SET = 100_000


def is_small(df: DataFrame, rows: int = SMALL_SET) -> bool:
    """At most ``rows`` rows? Reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def _pack(patterns: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return patterns.groupBy(*keys).agg(F.collect_list(F.struct(*keep)).alias("_pats"))


def _scan(texts: DataFrame, patterns: DataFrame, keys, keep, test) -> DataFrame:
    packed = F.broadcast(_pack(patterns, keys, keep))
    hits = F.explode(F.filter("_pats", test)).alias("_hit")
    joined = texts.join(packed, list(keys))
    return joined.select(*texts.columns, hits).select(
        *texts.columns, *[F.col("_hit")[c].alias(c) for c in keep if c not in keys]
    )


def _few(patterns: DataFrame, keys: Sequence[str]) -> bool:
    """At most a few strings in every case, and not many in all?"""
    top = patterns.limit(SMALL_SET + 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return (top[0] or 0) <= FEW_PER_CASE and (top[1] or 0) <= SMALL_SET


def contains_join(
    texts: DataFrame,
    patterns: DataFrame,
    keys: Sequence[str],
    text: str,
    pattern: str,
    row_key: Sequence[str],
    small: bool | None = None,
) -> DataFrame:
    """Rows of ``texts`` joined to the rows of ``patterns`` that occur in them.

    Both columns must already be folded the same way. ``small`` False goes by
    the join.
    """
    patterns = patterns.filter(F.length(pattern) > 0)
    keep = [c for c in patterns.columns if c not in keys]
    test = lambda p: F.col(text).contains(p[pattern])
    if small is not False and _few(patterns, keys):
        return _scan(texts, patterns, keys, keep, test)
    cols = [*texts.columns, *keep]
    sent = None if small is False else automaton.shipped(patterns, [*keys, pattern])
    if sent is not None:
        table = automaton.grouped(sent.append_column("_v", sent.column(pattern)), keys, pattern, "_v")
        hits = automaton.contained(texts, keys, text, table, "_hits", T.StringType()).withColumn(pattern, F.explode("_hits"))
        return hits.join(patterns, [*keys, pattern]).select(*cols)
    strings = patterns.filter(F.octet_length(pattern) >= filters.SIZES[0])
    keyed = filters.own_keys(strings, keys, pattern)
    # rows go along with their candidates, so no text is read or joined a second time
    cand = filters.candidates(texts, keyed, keys, text, pattern)
    found = cand.join(strings.join(keyed, [*keys, pattern]), [*keys, filters.KEY]).filter(F.col(text).contains(F.col(pattern))).select(*cols)
    # strings of under four bytes: few distinct ones exist, so match those and join their rows
    short = patterns.filter(F.octet_length(pattern) < filters.SIZES[0])
    if short.isEmpty():
        return found
    rest = _scan(texts, short.select(*keys, pattern).distinct(), keys, [pattern], test).join(short, [*keys, pattern])
    return found.unionByName(rest.select(*cols))


def words(col: Column) -> Column:
    """Distinct runs of word characters."""
    runs = lambda p: F.regexp_extract_all(col, F.lit(p), F.lit(0))
    # the plain class finds the same runs in ASCII text, faster
    return F.array_distinct(F.when(col.rlike(r"[^\x00-\x7F]"), runs(r"(?U)\w+")).otherwise(runs(r"\w+")))


def word_join(
    texts: DataFrame,
    patterns: DataFrame,
    keys: Sequence[str],
    text: str,
    word: str,
    row_key: Sequence[str],
    small: bool | None = None,
) -> DataFrame:
    """Candidates: rows of ``texts`` joined to the patterns whose ``word`` is one of their words."""
    low = F.lower(F.col(text))
    if small is None:
        small = is_small(patterns)
    if small:
        return texts.withColumn(word, F.explode(words(low))).join(F.broadcast(patterns), [*keys, word])
    return filters.with_known(texts, patterns, keys, words(low), word).join(patterns, [*keys, word])


def contained_ids(
    texts: DataFrame,
    patterns: DataFrame,
    keys: Sequence[str],
    text: str,
    pattern: str,
    ident: str,
    row_key: Sequence[str],
    out: str,
    small: bool | None = None,
) -> DataFrame:
    """Every row of ``texts`` with the ids of the patterns it contains, as an array."""
    patterns = patterns.filter(F.length(pattern) > 0)
    if small is not False and _few(patterns, keys):
        packed = F.broadcast(_pack(patterns, keys, [ident, pattern]))
        hits = F.filter("_pats", lambda p: F.col(text).contains(p[pattern]))
        ids = F.array_sort(F.array_distinct(F.transform(hits, lambda p: p[ident])))
        return texts.join(packed, list(keys), "left").withColumn(
            out, F.coalesce(ids, F.array().cast("array<bigint>"))).drop("_pats")
    sent = None if small is False else automaton.shipped(patterns, [*keys, pattern, ident])
    if sent is not None:
        return automaton.contained(texts, keys, text, automaton.grouped(sent, keys, pattern, ident), out, T.LongType())
    found = contains_join(texts.select(*dict.fromkeys([*row_key, *keys, text])), patterns, keys, text, pattern, row_key, False)
    ids = found.groupBy(*row_key).agg(F.array_sort(F.collect_set(ident)).alias(out))
    return texts.join(ids, list(row_key), "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<bigint>")))
