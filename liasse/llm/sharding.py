"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of an input partition go to each shard is drawn exactly: for one
partition after the other, and in it for one shard after the other, from the
hypergeometric law of the places that are still open. Every partition puts its
rows into a random order of its own and deals them out by its row of the
matrix; in each shard the rows are put into a random order once more. So every
arrangement is equally likely, and shard sizes differ by one row at most.

Only the counts go through the driver: one number per input partition in, one
matrix row per partition out. Random orders are hashes of a row number that is
written down with the rows first, so a lost executor changes nothing. The
order inside a shard comes from (part of the hash range, hash), with counted
offsets per part: no task sorts a whole shard.

Results for odd input: null text has size 1 and checksum 0; null and repeated
ids and repeated rows are rows like others; fewer rows than shards leave
shards empty; an empty table gives an empty one.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liasse.session import staged

SHARDS = 8
SEED = 20_240_229
PART_ROWS = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` things out of good + bad are good, by inversion around the mode."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(max((good + 1) * (drawn + 1) // (total + 2), low), high)
    share = good / total
    spread = (drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1)) ** 0.5
    reach = int(12 * spread) + 12  # what lies beyond has a probability below 1e-30
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratio = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[1:]) - np.log(bad - drawn + k[1:])
    choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    first = choose(good, k[0]) + choose(bad, drawn - k[0]) - choose(total, drawn)
    chance = np.exp(first + np.concatenate([[0.0], np.cumsum(ratio)]))
    upto = np.cumsum(chance)
    return int(k[min(np.searchsorted(upto, rng.random() * upto[-1], side="right"), k.size - 1)])


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row i: how many rows of partition i go to each shard; column sums differ by one at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in sizes:
        row, left, open_places = [], size, sum(room)
        for s in range(shards):
            got = hypergeometric(rng, room[s], open_places - room[s], left)
            open_places -= room[s]
            row.append(got)
            left -= got
        room = [r - g for r, g in zip(room, row, strict=True)]
        out.append(row)
    return out


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark, cols = df.sparkSession, df.columns
    numbered = staged(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.withColumn("_part", F.shiftright("_row", 33))
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())  # one row per input partition
    dealt = matrix([n for _, n in counts], shards, seed)
    upto = [(part, [int(x) for x in np.cumsum(row)]) for (part, _), row in zip(counts, dealt, strict=True)]
    ends = spark.createDataFrame(upto, "_part long, _ends array<long>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row")
    placed = (rows.withColumn("_n", F.row_number().over(local)).join(ends, "_part")
              .select(*cols, "_row", F.size(F.filter("_ends", lambda e: e < F.col("_n"))).alias("shard")))
    total = sum(n for _, n in counts)
    ranges = max(1, -(-total // (shards * PART_ROWS)))
    order = F.xxhash64(F.lit(seed + 1), "_row")
    exchanged = staged(placed.withColumn("_order", order).withColumn(
        "_range", F.shiftright(F.shiftrightunsigned("_order", 33) * F.lit(ranges).cast("long"), 31)))
    sizes = exchanged.groupBy("shard", "_range").count()
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("shard", "_range").orderBy(F.shiftrightunsigned("_order", 33), "_order", "_row")
    return (exchanged.withColumn("_n", F.row_number().over(inner)).join(starts, ["shard", "_range"])
            .select(*cols, "shard", (F.col("_start") + F.col("_n") - 1).cast("long").alias("slot")))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
