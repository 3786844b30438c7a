"""Benchmark decontamination: which documents hold a passage of a benchmark item.

For an item of n words the windows of n words of every document are compared
with it. Windows and items get a 64-bit SimHash of their words. Fingerprints
within ``RADIUS`` bits agree on at least one of RADIUS + 1 blocks, so a lookup
of each block among the items' blocks finds all of them. Candidates are
verified by the weighted Jaccard of their five-word shingles (weight:
occurrences), which must reach ``SIMILARITY``.

A window that reaches the similarity holds at least that share of its shingles
in common with an item. Running counts of item shingles per document give the
windows with so many of them; the others can't qualify and get no fingerprint.
Nothing is shuffled: the benchmark goes to the documents, in blocks of
``BLOCK_SHINGLES`` shingles, one pass over the documents per block.

SimHash takes single words: two windows whose five-word shingles have a
Jaccard of 0.8 differ in few words, and each word moves each bit's sum by one.
``RADIUS`` covers windows in which up to about a fifth of the words differ, but
not surely: by a reviewer's simulation 5e-5 to 1.5e-4 of the windows of 40 to
200 words with the most changed words at their edges differ in more bits. The
tests compare with brute force over all windows.

Results for odd input: null texts count as empty and hold no passage; items
without words are left out, those without an id are reported as null; items shorter than a shingle are one shingle;
equal items are each reported; repeated rows are kept; empty tables give no
passages and keep every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liasse.llm import shingles as sh
from liasse.llm.batches import map_batches

SIMILARITY = 0.8
RADIUS = 20
BLOCK_SHINGLES = 4_000_000
WINDOWS_AT_ONCE = 20_000
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts``, by running sums of each bit over the span they cover."""
    low = int(starts[0])
    span = words[low : int(starts[-1]) + size]
    ones = np.zeros((span.size + 1, 64), np.int32)
    np.cumsum((span[:, None] >> _BITS) & np.uint64(1), axis=0, out=ones[1:], dtype=np.int32)
    count = ones[starts - low + size] - ones[starts - low]
    return ((2 * count > size).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def blocks_of(prints: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """The radius + 1 blocks of the fingerprints."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    return [(prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at_a], b[1][at_b]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


class Items:
    """The items of one size with the lookup tables of their fingerprint blocks."""

    def __init__(self, size: int, ids: list[int], words: list[np.ndarray], radius: int):
        self.size, self.ids, self.radius = size, ids, radius
        self.weights = [sh.weighted(sh.rolled(w, min(sh.SIZE, size))) for w in words]
        self.prints = np.concatenate([fingerprints(w, np.zeros(1, np.int64), size) for w in words])
        self.orders = [np.argsort(b, kind="stable") for b in blocks_of(self.prints, radius)]
        self.sorted = [b[o] for b, o in zip(blocks_of(self.prints, radius), self.orders, strict=True)]

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """Every (window, item) whose fingerprints differ in at most ``radius`` bits."""
        met = []
        for block, order, values in zip(blocks_of(prints, self.radius), self.orders, self.sorted, strict=True):
            left, right = np.searchsorted(values, block, "left"), np.searchsorted(values, block, "right")
            n = right - left
            window = np.repeat(np.arange(prints.size), n)
            spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
            item = order[spot]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            met.append(window[close] * len(self.ids) + item[close])
        for code in np.unique(np.concatenate(met)):
            yield int(code) // len(self.ids), int(code) % len(self.ids)


class Benchmark:
    """A block of the benchmark, ready to be compared with documents."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], radius: int, similarity: float):
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, words in rows:
            by_size.setdefault(words.size, []).append((item, words))
        self.similarity = similarity
        self.groups = [Items(n, [i for i, _ in own], [w for _, w in own], radius) for n, own in sorted(by_size.items())]
        self.known = {}  # shingle width: the shingles, sorted, with the groups of items that have them
        for width in {min(sh.SIZE, g.size) for g in self.groups}:
            own = [(k, n) for n, g in enumerate(self.groups) if min(sh.SIZE, g.size) == width for k in {k for w, _ in g.weights for k in w.tolist()}]
            own.sort()
            self.known[width] = np.array([k for k, _ in own], np.uint64), np.array([n for _, n in own], np.int64)

    def matches(self, words: np.ndarray) -> dict[int, float]:
        """Item id to the best similarity of a window, where it reaches the limit."""
        found: dict[int, float] = {}
        for width, (known, group_of) in self.known.items():
            own = sh.rolled(words, width)
            left = np.searchsorted(known, own)
            hits = np.flatnonzero(known[np.minimum(left, known.size - 1)] == own)
            if not hits.size:
                continue
            left = left[hits]
            n = np.searchsorted(known, own[hits], "right") - left
            place = np.repeat(hits, n)
            which = group_of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)]
            for g in np.unique(which):
                self._verify(self.groups[g], words, own, place[which == g], found)
        return found

    def _verify(self, group: Items, words: np.ndarray, own: np.ndarray, hits: np.ndarray, found: dict[int, float]) -> None:
        """Looks up the windows of one size with enough shingles of the items of that size."""
        many = group.size - min(sh.SIZE, group.size) + 1
        need = int(np.ceil(self.similarity * many - 1e-9))
        if hits.size < need or words.size < group.size:
            return
        last = hits[need - 1 :]  # a window must reach from at most the first of `need` hits to the last of them
        lows, highs = np.maximum(last - many + 1, 0), np.minimum(hits[: last.size], words.size - group.size)
        spans = [np.arange(a, b + 1) for a, b in zip(lows, highs, strict=True) if a <= b]
        if not spans:
            return
        every = np.unique(np.concatenate(spans))
        for i in range(0, every.size, WINDOWS_AT_ONCE):
            starts = every[i : i + WINDOWS_AT_ONCE]
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > group.size) + 1):
                for window, item in group.near(fingerprints(words, part, group.size)):
                    start = int(part[window])
                    best = weighted_jaccard(sh.weighted(own[start : start + many]), group.weights[item])
                    if best >= self.similarity and best > found.get(group.ids[item], 0.0):
                        found[group.ids[item]] = best


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The items as word hashes, in blocks of a bounded number of shingles."""
    rows, held = [], 0
    spark_rows = benchmark.select(F.col(item).cast("long").alias("i"), sh.plain_words(F.col(text)).alias("t")).filter("trim(t) <> ''")
    for row in spark_rows.toLocalIterator():
        words, _ = sh.hashed_words(pa.array([row["t"]]))
        if rows and held + words.size > BLOCK_SHINGLES:
            yield rows
            rows, held = [], 0
        rows.append((row["i"], words))
        held += words.size
    if rows:
        yield rows


def passages(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
             item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """``row``: the columns ``keep`` of ``docs``; ``items``: array of (item_id, similarity) of the items found in the text."""
    kind = "array<struct<item_id:bigint,similarity:double>>"
    shape = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))
    pair = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    out = docs.select(F.struct(*docs.columns).alias("row"), F.array().cast(kind).alias("items"))
    blocks = _item_blocks(benchmark, item, item_text)
    rows = next(blocks, None)
    while rows:
        sent, rows = docs.sparkSession.sparkContext.broadcast(rows), next(blocks, None)
        if rows is None and text not in keep:  # only an earlier pass needs the text again
            out = out.select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "items", F.col(f"row.`{text}`").alias("text"))
        else:
            out = out.select("row", "items", F.col(f"row.`{text}`").alias("text"))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value, radius, similarity)
            for batch in batches:
                words, bounds = sh.hashed_words(batch.column("words"))
                made = [[{"item_id": i, "similarity": s} for i, s in bench.matches(words[a:b]).items()]
                        for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("items"), pa.array(made, shape)], ["row", "items", "more"])

        given = out.select("row", "items", sh.plain_words(F.col("text")).alias("words"))
        out = map_batches(given, run, T.StructType([given.schema["row"], given.schema["items"], T.StructField("more", pair)])).select(
            "row", F.array_sort(F.concat("items", "more")).alias("items"))
    return out.select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "items")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and best similarity of every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = passages(narrow, benchmark, ["doc_id"], **options)
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["item_id"])))
    return found.select("row.doc_id", (F.size("items") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
                        ids.alias("item_ids"), F.array_max(F.transform("items", lambda x: x["similarity"])).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return passages(docs, benchmark, docs.columns, **options).filter(F.size("items") == 0).select("row.*")
