"""Running totals and capped texts that hold when one key has most of the rows.

A plain window over a key puts all its rows in one task. Here the rows of a
key are cut into range blocks of their order column, block totals are summed
(one row per block), and each block then runs its own window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding
#: greater than any block, by type
_LAST = {"bigint": 2**63 - 1, "int": 2**31 - 1, "string": "\U0010ffff"}


def block_offsets(df: DataFrame, keys: Sequence[str], block: str, value: Column) -> DataFrame:
    """Per key and block: the total of all earlier blocks, as ``_before``."""
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(UNBOUNDED, -1)
    return totals.select(
        *keys, block, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    block: Column,
    out: str,
    below: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one within ``keys``.

    ``block`` must be monotone in ``order``; rows where it is null come last. With ``below``, rows whose total
    already reached that bound are dropped, whole blocks before any window.
    """
    # rows without a place in the order come last, in a block of their own
    src = df.withColumn("_blk", F.coalesce(block, F.lit(_LAST[dict(df.select(block.alias("b")).dtypes)["b"]]))).withColumn("_val", value)
    offsets = block_offsets(src, keys, "_blk", F.col("_val"))
    if below is not None:
        offsets = offsets.filter(F.col("_before") < below)
    inside = Window.partitionBy(*keys, "_blk").orderBy(*[F.asc_nulls_last(c) for c in order]).rowsBetween(UNBOUNDED, -1)
    got = (
        src.join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum("_val").over(inside), F.lit(0)))
        .drop("_blk", "_val", "_before")
    )
    return got if below is None else got.filter(F.col(out) < below)


def capped_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    text: str,
    cap: int | None,
    sep: str = "\n\n",
    out: str = "text",
) -> DataFrame:
    """Join the texts of a key in order, up to ``cap`` characters (None: all).

    Only rows that start below the cap (or whose separator does) are ever
    gathered, so a gathered group holds about ``cap`` characters plus one row.
    """
    filled = df.filter(F.length(text) > 0)
    need = running_total(
        filled.select(*keys, *order, F.col(text).alias("_text"), block.alias("_b")),
        keys, order, F.length("_text") + len(sep), F.col("_b"), "_at", below=None if cap is None else cap + len(sep),
    )
    parts = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col("_text"))))
    joined = F.array_join(F.transform(parts, lambda p: p["_text"]), sep)
    return need.groupBy(*keys).agg((joined if cap is None else F.left(joined, F.lit(cap))).alias(out))


def parted_concat(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, text: str, size: int, sep: str = "\n\n", out: str = "text", part: str = "part",
) -> DataFrame:
    """The whole joined text of a key, in parts: one row per key and ``part``, in the order of ``part``.

    A part holds the texts that begin in its ``size`` characters, so a gathered
    group holds about ``size`` characters plus one row, however long the whole
    is. Behind a text longer than that, numbers are left out.
    """
    placed = running_total(
        df.filter(F.length(text) > 0).select(*keys, *order, F.col(text).alias("_text"), block.alias("_b")),
        keys, order, F.length("_text") + len(sep), F.col("_b"), "_at")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda p: p["_text"])
    return placed.withColumn(part, F.floor(F.col("_at") / size)).groupBy(*keys, part).agg(F.array_join(texts, sep).alias(out))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | None = 1,
               rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key (None: all, ranked). Spark prunes to ``n`` per map task before the shuffle."""
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    got = df.withColumn(name, F.row_number().over(w))
    got = got if n is None else got.filter(F.col(name) <= n)
    return got if rank else got.drop(name)


def page_block(col: str, width: int = 512) -> Column:
    """Range block of a numeric order column."""
    return F.floor(F.col(col) / width).cast("bigint")


def name_block(col: str) -> Column:
    """4096 even blocks of a string key, by digest; the key's order is (digest prefix, key)."""
    return F.left(F.sha1(F.col(col)), F.lit(3))
