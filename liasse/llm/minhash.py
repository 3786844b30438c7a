"""Near-duplicate groups by ProbMinHash signatures, banding and exact verification.

Every distinct text becomes a probability distribution over its five-word
shingles (weight: occurrences). Each shingle's arrivals form a Poisson process
whose rate is its weight; an arrival falls on a random slot, the earliest one
wins the slot, and a shingle stops as soon as its next arrival is later than
every slot's winner. Two texts agree on a slot with the probability Jaccard of
their distributions. Bands of slots give candidates, the exact probability
Jaccard verifies them.

Texts that share a band are not paired with each other: each is held against
the most central text of the band (its pivot: the one that meets most others
over all its bands), verified links are merged into groups, the texts of bands with several groups are held against the most central
text of the largest one, and only texts of a band which are still in different
groups meet afterwards. Those meetings are pruned by what each text has alone
(see :func:`own_odds`; nothing is lost by that), by the triangle inequality, which the
distance (1 - probability Jaccard) obeys, with the known distances to the
pivot, and by the share of slots on which the signatures agree: a pair is
verified from ``SIMILARITY - MARGIN`` on. A pair of just that similarity fails
to share a band in 4.7e-8 of all cases and falls below the margin in 3.9e-8,
so the prune loses no more than the bands do.

Results for odd input: null text counts as empty; equal texts always form one
group, texts without words no other; null or repeated ids are kept row by row
and join no groups, only the texts do; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse.llm import shingles as sh
from liasse.llm.batches import map_batches
from liasse.session import staged

BANDS = 32
ROWS = 4
SLOTS = 512
SIMILARITY = 0.8
MARGIN = 0.1
_ONE = np.uint64(1)


def signature(keys: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The winning shingle of every slot (a power of two up to 2048); ``keys`` must not be empty."""
    first, winner = np.full(slots, np.inf), np.zeros(slots, np.uint64)
    last, live, step = np.zeros(keys.size), np.arange(keys.size), 0
    needed = slots * (np.log(slots) + 1)
    while live.size:
        width = int(min(4096, 1 + needed // live.size) if np.isinf(first.max()) else max(2, 64 // live.size))
        salt = sh.mix(np.arange(step, step + width, dtype=np.uint64) + _ONE)
        draw = sh.mix(keys[live, None] ^ salt)
        gaps = -np.log(((draw >> np.uint64(11)) + 0.5) * 2.0**-53) / weights[live, None]
        at = last[live, None] + np.cumsum(gaps, axis=1)
        slot = (draw & np.uint64(2047)).astype(np.int64) % slots  # bits that the gap leaves out
        here = first.copy()
        np.minimum.at(here, slot.ravel(), at.ravel())
        row, col = np.nonzero((at == here[slot]) & (at < first[slot]))
        winner[slot[row, col]] = keys[live[row]]
        first = here
        last[live] = at[:, -1]
        live = live[last[live] < first.max()]
        step += width
    return winner


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles d of 1 / sum over all d' of max(a'/a, b'/b)."""
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not common.size:
        return 0.0
    wa, wb = a[1][at_a], b[1][at_b]
    order = np.argsort(wb / wa, kind="stable")
    wa, wb = wa[order], wb[order]
    ratio = wb / wa
    # shingles of b alone have an endless ratio, those of a alone the ratio 0
    upto_a = a[1].sum() - wa.sum() + np.concatenate([[0.0], np.cumsum(wa)])
    from_b = b[1].sum() - np.concatenate([[0.0], np.cumsum(wb)])
    cut = np.searchsorted(ratio, ratio, side="right")
    return float((1.0 / (upto_a[cut] / wa + from_b[cut] / wb)).sum())


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sketches(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """doc_id, text key, band hashes and signature of every row; both empty for texts without words.

    Bands take the first bands x rows slots whole; the signature keeps one
    byte of every slot, eight in a number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = sh.mix(np.arange(rows, dtype=np.uint64) + np.uint64(7))
        none = np.empty(0, np.int64)
        lists = lambda parts: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate([none, *parts])))
        for batch in batches:
            banded, sigs = [], []
            for found in sh.column_shingles(batch.column("_words")):
                if found.size:
                    win = signature(*sh.weighted(found), slots)
                    banded.append(sh.mix((win[: bands * rows].reshape(bands, rows) * mult).sum(axis=1)).view(np.int64))
                    sigs.append(win.astype(np.uint8).view(np.int64))
                else:
                    banded.append(none)
                    sigs.append(none)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), lists(banded), lists(sigs)],
                                             ["doc_id", "text_key", "bands", "sig"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), sh.plain_words(F.col(text)).alias("_words"))
    return map_batches(narrow, run, "doc_id long, text_key binary, bands array<long>, sig array<long>")


def differing(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """How many slots of two signatures differ: the bits of every differing byte are folded onto its lowest one."""
    total = F.lit(0)
    for i in range(slots // 8):
        t = a[i].bitwiseXOR(b[i])
        for by in (4, 2, 1):
            t = t.bitwiseOR(F.shiftrightunsigned(t, by))
        total = total + F.bit_count(t.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def texts_of(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text_key and words of the texts in ``pairs``, written once.

    ``docs``: doc_id, text; ``ids``: the smallest doc_id of each text key, by
    which one row of each needed text is read, however many copies it has.
    """
    needed = pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct().join(ids, "text_key")
    needed = needed.select(F.col("text_key").alias("_key"), F.col("copy_id").alias("_id"))
    keyed = docs.select(text_key(F.col("text")).alias("text_key"), F.col("doc_id"), sh.plain_words(F.col("text")).alias("_text"))
    found = keyed.join(needed, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return staged(found.dropDuplicates(["text_key"]).select("text_key", "_text"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` of text keys (a, b) with their exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)  # neighbouring rows share a pivot
        for batch in batches:
            sims = []
            for key, ta, tb in zip(batch.column("b").to_pylist(), *(sh.column_shingles(batch.column(c)) for c in ("_ta", "_tb")), strict=True):
                if kept[0] != key:
                    kept = (key, sh.weighted(tb))
                sims.append(probability_jaccard(sh.weighted(ta), kept[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    left = texts.withColumnsRenamed({"text_key": "a", "_text": "_ta"})
    right = texts.withColumnsRenamed({"text_key": "b", "_text": "_tb"})
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb")
    return map_batches(joined, run, "a binary, b binary, similarity double")


def own_odds(texts: DataFrame) -> DataFrame:
    """node, odds of each text (text_key, _text) that has shingles none of the others has: u / (1 - u) for their share u of its weight.

    Texts with the shares u and v of shingles that the other lacks have at most the similarity
    1 / (1 + u / (1 - u) + v / (1 - v)): a common shingle of weights p and q adds 1 / (1 / p + v / q) at most,
    which is concave, so the sum is at most that of all common weights at once, 1 - u and 1 - v.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("text_key").to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            rows = sh.column_shingles(batch.column("_text"))
            for at in range(0, len(rows), 64):
                found = [sh.weighted(r) for r in rows[at : at + 64]]
                own = np.repeat(keys[at : at + 64], [len(k) for k, _ in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.concatenate([k for k, _ in found]).view(np.int64), own[:, 0].copy(), own[:, 1].copy(),
                                           np.concatenate([w / w.sum() for _, w in found]))], ["shingle", "high", "low", "share"])

    each = map_batches(texts.select("text_key", "_text"), run, "shingle long, high long, low long, share double")
    # numbers alone, so that the grouping hashes; the maximum of one row is that row
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("high", "low", "share")]).filter("n = 1")
    word = lambda c: F.lpad(F.hex(c), 16, "0")
    share = F.least(F.sum("share"), F.lit(1.0))
    return alone.groupBy("high", "low").agg(F.when(share < 1 - 1e-12, share / (1 - share)).otherwise(float("inf")).alias("odds")).select(
        F.unhex(F.concat(word("high"), word("low"))).alias("node"), "odds")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for all nodes of the links (a, b).

    Every round hooks each root to its smallest neighbouring root, follows the
    hooks to their end by doubling, and contracts the links. Only links between
    different roots remain, so each round works on fewer rows; the tables are
    written to the shared folder between steps.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = staged(nodes.select("node", F.col("node").alias("root")))
    open_links = staged(links.select("a", "b").filter("a <> b").distinct())
    while not open_links.isEmpty():
        both = open_links.union(open_links.select("b", "a"))
        hook = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("r"), F.least("a", "low").alias("up")))
        moving = True
        while moving:
            nxt = hook.select(F.col("r").alias("up"), F.col("up").alias("top"))
            hook = staged(hook.join(nxt, "up", "left").select(
                "r", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
            moving = not hook.filter("moved").isEmpty()
        roots = staged(roots.join(hook.withColumnRenamed("r", "root"), "root", "left")
                       .select("node", F.coalesce("up", "root").alias("root")))
        to = lambda c: hook.select(F.col("r").alias(c), F.col("up").alias(f"_{c}"))
        moved = open_links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        open_links = staged(moved.filter("a <> b").distinct())
    return roots


def _mains(buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the buckets with their roots, and (band, main, groups): the largest group of each band and how many it has."""
    full = staged(buckets.join(roots, "node", "left").select(*buckets.columns, F.coalesce("root", "node").alias("root")))
    per = full.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    return full, per.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("groups"))


def _by_group(buckets: DataFrame, roots: DataFrame, central: DataFrame) -> DataFrame:
    """The bands that hold several groups, with the most central text of their largest group as pivot.

    That text stands for its group in all bands, so each text of these bands is
    held against it once, and its distances are known in every one of them.
    """
    full, mains = _mains(buckets, roots)
    heads = central.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("main")).agg(F.max(F.struct("met", "node"))["node"].alias("pivot"))
    open_bands = mains.filter("groups > 1").join(heads, "main").select("band", "pivot")
    return staged(full.drop("pivot", "root").join(open_bands, "band"))


def _meetings(buckets: DataFrame, near: DataFrame, roots: DataFrame, one: DataFrame, threshold: float, margin: float, slots: int,
              odds: DataFrame | None = None) -> DataFrame:
    """Pairs of a band that are still in different groups and may be similar, each from the first band it shares.

    Per band the largest group stays whole; texts outside it meet the others
    of the band. Pairs go whose distances to the pivot differ by more than a
    link is long, or whose signatures agree on fewer slots than
    threshold - margin. With ``odds`` (:func:`own_odds` of all texts of the
    buckets), texts go that have too much alone for any link, and pairs that
    have so together.
    """
    known = near.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("far"))
    full, main = _mains(buckets.join(known, ["node", "pivot"], "left").withColumn("far", F.coalesce("far", F.lit(0.0))), roots)
    most = 1 / threshold - 1 + 1e-9
    held = full.withColumn("odds", F.lit(0.0)) if odds is None else full.join(odds, "node", "left").withColumn("odds", F.coalesce("odds", F.lit(0.0)))
    sides = staged(held.join(main.filter("groups > 1").select("band", "main"), "band").filter((F.col("node") != F.col("pivot")) & (F.col("odds") <= most))
                   .join(one.select(F.col("text_key").alias("node"), "sig", "bands"), "node"))
    side = sides.filter("root <> main").select(
        "band", "no", F.col("node").alias("x"), F.col("root").alias("xr"), F.col("far").alias("xf"), F.col("sig").alias("xs"), F.col("bands").alias("xb"), F.col("odds").alias("xo"))
    other = sides.select(
        "band", "main", F.col("node").alias("y"), F.col("root").alias("yr"), F.col("far").alias("yf"), F.col("sig").alias("ys"), F.col("bands").alias("yb"), F.col("odds").alias("yo"))
    first = F.array_position(F.zip_with("xb", "yb", lambda p, q: p == q), True)
    met = side.join(other, "band").filter(
        (F.col("xr") != F.col("yr")) & (F.abs(F.col("xf") - F.col("yf")) <= 1 - threshold + 1e-9)
        & (F.col("xo") + F.col("yo") <= most)
        & ((F.col("yr") == F.col("main")) | (F.col("x") < F.col("y")))
        & (differing(F.col("xs"), F.col("ys"), slots) <= slots * (1 - threshold + margin)) & (first == F.col("no") + 1))
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, threshold: float = SIMILARITY,
                    margin: float = MARGIN, slots: int = SLOTS) -> DataFrame:
    """doc_id, text_key, copy_id, root, class_id: one row for each row of ``docs``.

    ``root`` is the text key that names the group. ``class_id`` is the smallest
    doc_id of the group, ``copy_id`` the smallest one among equal texts; both
    are null where all ids are, and several groups may have the same.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    drawn = staged(sketches(base, "text", bands, rows, slots))
    ids = staged(drawn.groupBy("text_key").agg(F.min("doc_id").alias("copy_id")))
    one = drawn.join(ids.withColumnRenamed("copy_id", "_id"), "text_key").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    one = staged(one.dropDuplicates(["text_key"]).select("text_key", "sig", "bands"))
    spread = one.select(F.col("text_key").alias("node"), F.posexplode("bands").alias("no", "band"))
    shared = staged(spread.join(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "band"))
    central = staged(shared.groupBy("node").agg(F.sum("n").alias("met")))
    pivots = shared.join(central, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("pivot"))
    buckets = staged(shared.drop("n").join(pivots, "band"))
    star = staged(buckets.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    texts = texts_of(star, base, ids)  # later pairs have no others
    near = staged(verified(star, texts))
    links = near.filter(F.col("similarity") >= threshold)
    roots = components(links)
    buckets = _by_group(buckets, roots, central)
    near = staged(verified(staged(buckets.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()), texts))
    links = links.unionByName(near.filter(F.col("similarity") >= threshold))
    roots = components(links)
    odds = staged(own_odds(texts.join(buckets.select(F.col("node").alias("text_key")).distinct(), "text_key", "left_semi")))
    more = staged(verified(staged(_meetings(buckets, near, roots, one, threshold, margin, slots, odds)), texts)).filter(F.col("similarity") >= threshold)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    placed = staged(ids.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
                    .select("text_key", "copy_id", F.coalesce("root", "text_key").alias("root")))
    tops = placed.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    return (drawn.select("doc_id", "text_key").join(placed.join(tops, "root"), "text_key")
            .select("doc_id", "text_key", "copy_id", "root", "class_id"))


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id."""
    found = near_duplicates(docs, text, **options)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root", "doc_id").agg(
        F.min("text_key").alias("key"), F.count(F.lit(1)).alias("n"))
    chosen = staged(first.select(F.col("doc_id").alias("id"), "key", "n"))
    # the rows travel whole, so that no column of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col(text)).alias("at"), F.col("doc_id").cast("long").alias("of"))
    kept = rows.join(chosen, (F.col("at") == F.col("key")) & F.col("of").eqNullSafe(F.col("id")))
    again = kept.filter("n > 1").dropDuplicates(["id", "key"])
    return kept.filter("n = 1").select("row").unionByName(again.select("row")).select("row.*")
