"""Quality rules: a ledger of measurements and failure bits, and policies over it.

Every rule is evaluated once per text. The ledger keeps the measurements and
one bit per failed rule. A policy is a version and a mask of the rules it
applies; it, and what each of its rules alone takes out, follow from the bits
without reading texts again: the ledger is summed up to a count per bit
pattern, at most 2 to the number of rules, and masks are applied to those.

Words are runs of anything but space, tab, line feed, vertical tab, form feed
and carriage return. Results for odd input: null text has no words and fails
``few_words``; a rule about shares can't fail without words; texts of any
length are measured whole; repeated rows stay; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse.llm import shingles as sh
from liasse.llm.batches import map_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SYMBOLS = b"#*$%&|<>"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LINE = np.arange(256) == 10
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_POINT = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)

#: Rules in the order of their bits; true means failed.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 2 and 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "n_letters > 0 and 100 * n_upper > 50 * n_letters",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Version: the rules that a text has to meet.
POLICIES = {"base-1": BASE, "strict-1": sum(BIT.values())}
POLICY = "strict-1"


def _measured(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("_lines")
        words, word_at, bounds = sh.segments(column, _SPACE)
        lines, line_at, line_bounds = sh.segments(column, _LINE)
        data, ends = sh.bytes_of(column)
        counted = {k: sh.counted(data, ends, table) for k, table in (
            ("word_chars", _POINT), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER))}
        stops = np.append(line_at[1:], data.size)
        has_word = np.searchsorted(word_at, stops) > np.searchsorted(word_at, line_at)
        dup, n_lines, repeated = [], [], []
        for a, b, la, lb in zip(bounds[:-1], bounds[1:], line_bounds[:-1], line_bounds[1:], strict=True):
            own = lines[la:lb][has_word[la:lb]]
            n_lines.append(own.size)
            dup.append(own.size - np.unique(own).size)
            repeated.append(_repeat_words(words[a:b]))
        made = {"n_words": np.diff(bounds), **counted, "n_dup_lines": dup, "n_lines": n_lines, "n_repeat_words": repeated}
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(made[m], pa.int64()) for m in MEASURES)], [*names, *MEASURES])


def _repeat_words(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    windows = sh.rolled(words, width)
    if windows.size < 2:
        return 0
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    spots = np.flatnonzero(counts[which] > 1)
    edge = np.zeros(words.size + 1, np.int64)
    edge[spots] += 1
    np.subtract.at(edge, spots + width, 1)
    return int((np.cumsum(edge) > 0).sum())


def ledger(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``df``, all measurements, and ``failed``: the bits of the failed rules."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{m} long" for m in MEASURES])
    lines = df.select(*keep, F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("_lines"))
    measured = map_batches(lines, lambda batches: _measured(batches, keep), schema)
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """version, rule, kept, kept_without, only_this: per policy and rule, from the counts per bit pattern.

    ``kept_without`` counts rows that pass if the rule is taken out of the
    policy, ``only_this`` those that no other rule of the policy fails.
    """
    policies = POLICIES if policies is None else policies
    counts = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    grid = [F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(mask).cast("long").alias("mask"), F.lit(bit).cast("long").alias("bit"))
            for v, mask in policies.items() for name, bit in BIT.items() if mask & bit]
    each = counts.select("failed", "n", F.explode(F.array(*grid)).alias("p")).select("failed", "n", "p.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    rest = hit.bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("version", "rule").agg(
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"))


def report(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """doc_id, measurements, base_failed, kept and the failure bits of every document."""
    book = ledger(docs.select("doc_id", "text"), ["doc_id"])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes(BASE)).alias("base_failed"), passes(BASE | POLICIES[policy]).alias("kept"), "failed", "n_lines", "n_upper", "n_letters")
