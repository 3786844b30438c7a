"""Phrase collocations, counted on the dictionary of a prefix-free parse.

Each text is a run of words, lower-cased for A-Z and set apart by spaces and
tabs; ``BREAKS`` end a piece, and no phrase goes across one. Wherever the hash
of ``longest - 1`` words in a row is divisible by ``PERIOD``, a chunk ends
with these words and the next one begins with them, so equal passages give
equal chunks wherever they stand. The distinct chunks of a language and their
frequencies are the dictionary. N-grams are counted inside distinct chunks,
weighted by frequency; one that starts in the words shared with the next chunk
counts there only, so every occurrence counts once.

Longer n-grams are counted only where both of their parts with one word less
are frequent enough. A bit table of the frequent parts tells that: it has
``BITS_EACH`` bits for a part, ``MOST_BITS`` at most, and may let others pass,
which the counts then sort out; it never holds back a frequent one.

Results for odd input: null text counts as empty and has no words; null lang
is ``und``; texts of any length are read whole, in pieces that end where a
chunk does; repeated rows count each time; rows without words give nothing; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse.llm import shingles as sh
from liasse.llm.batches import map_batches
from liasse.plans.ordering import first_rows
from liasse.session import staged

LONGEST = 3
LEAST = 10
TOP = 2000
CONTAINED = 50
SCALE = 1_000_000
PERIOD = 16
BREAKS = ".,;:!?\n\x0b\x0c\r"
SPACES = " \t"
PIECE = 1 << 20
GRAMS = 1 << 18
SALTS = 8
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.isin(np.arange(256), np.frombuffer(BREAKS.encode(), np.uint8))
_APART = _BREAK | np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    begins = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begins, sizes)


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of a buffer as strings; they may overlap."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(starts.size, pa.py_buffer(offsets), pa.py_buffer(data[_ranges(starts, sizes)])).cast(pa.string())


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word; the data must end with a byte that sets apart."""
    hashes, starts = sh._hash_piece(data, _APART)
    inside = ~_APART[data]
    return hashes, starts, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1


def _cut(data: np.ndarray, bounds: np.ndarray, overlap: int, period: int, whole: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """Row, text and number of own words of each chunk, and from which byte on nothing was cut.

    ``bounds``: where rows begin and end. With ``whole`` rows end with the
    data; otherwise (one row) its last chunk is left for later.
    """
    hashes, starts, ends = _words(data)
    n = starts.size
    if not n:
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64), data.size
    row = np.searchsorted(bounds, starts, "right") - 1
    first = np.concatenate([[True], row[1:] != row[:-1]])
    cut = first.copy()
    if n > overlap:
        met = sh.rolled(hashes, overlap) % np.uint64(period) == 0
        cut[: met.size] |= met & (row[: met.size] == row[overlap - 1 :])
    at = np.flatnonzero(cut)
    stop = np.append(at[1:], n)
    last = np.append(first[at[1:]], True)  # the row's last chunk has no words of a next one
    done = data.size
    if not whole:
        done, at, stop, last = (int(starts[at[-1]]) if at.size > 1 else 0), at[:-1], stop[:-1], last[:-1]
    # one blank between words of a piece, a line end between pieces
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    parted = np.append(breaks[starts[1:]] != breaks[ends[:-1]], True)
    sizes = ends - starts + 1
    new_ends = np.cumsum(sizes)
    plain = np.empty(int(new_ends[-1]), np.uint8)
    here = np.ones(plain.size, bool)
    here[new_ends - 1] = False
    plain[here] = data[_ranges(starts, sizes - 1)]
    plain[new_ends - 1] = np.where(parted, 10, 32)
    upto = stop + np.where(last, 0, overlap) - 1
    return row[at], slices(plain, (new_ends - sizes)[at], new_ends[upto] - 1), stop - at, done


def row_chunks(column: pa.Array, overlap: int, period: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Chunks (row, text, own words) of a column of texts that end with a break; short rows together, long ones in pieces."""
    data, ends = sh.bytes_of(column)
    data, at = _LOWER[data], 0
    while at < ends.size - 1:
        upto = max(int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1, at + 1)
        if ends[upto] - ends[at] <= PIECE:
            rows, chunks, own, _ = _cut(data[ends[at] : ends[upto]], ends[at:upto] - ends[at], overlap, period, True)
            yield rows + at, chunks, own
        else:
            place, step = int(ends[at]), PIECE
            while place < ends[upto]:
                stop = min(place + step, int(ends[upto]))
                while stop < ends[upto] and not _APART[data[stop - 1]]:
                    stop += 1
                rows, chunks, own, done = _cut(data[place:stop], np.array([0]), overlap, period, stop == ends[upto])
                yield rows + at, chunks, own
                place, step = place + done, PIECE if done else 2 * step
        at = upto


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, period: int = PERIOD) -> DataFrame:
    """lang, chunk, own, n: the distinct chunks, how many of their words are their own, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, chunks, own in row_chunks(batch.column("_text"), longest - 1, period):
                if len(chunks):
                    yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows)), chunks, pa.array(own, pa.int64())], ["lang", "chunk", "own"])

    rows = docs.select(language(F.col(lang)).alias("lang"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("_text"))
    return map_batches(rows, run, "lang string, chunk string, own long").groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("n"))


def _lang_hashes(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    own = np.array([zlib.crc32(v.encode()) for v in coded.dictionary.to_pylist()], np.uint64)
    return sh.mix(own + np.uint64(1))[coded.indices.to_numpy()]


def _grams(chunks: pa.Array, own: np.ndarray, langs: np.ndarray, size: int, table: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Row and text of each n-gram that begins in the own words of a chunk (which ends with a break)."""
    data, bounds = sh.bytes_of(chunks)
    hashes, starts, ends = _words(data)
    row = np.searchsorted(bounds, starts, "right") - 1
    place = np.arange(starts.size) - np.searchsorted(row, np.arange(own.size))[row]
    ok = place < own[row]
    whole = data[ends] == 32  # the next word is of the same piece
    for k in range(1, size):
        ok[starts.size - k :] = False
        ok[: starts.size - k] &= whole[k - 1 : starts.size - 1]
    if table is not None:
        parts = sh.mix(sh.rolled(hashes, size - 1) ^ langs[row[: max(starts.size - size + 2, 0)]]) & np.uint64(table.size * 8 - 1)
        known = (table[(parts >> np.uint64(3)).astype(np.int64)] >> (parts & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        ok[: known.size - 1] &= known[:-1] & known[1:]
    at = np.flatnonzero(ok)
    return row[at], slices(data, starts[at], ends[at + size - 1])


def counted(chunks: DataFrame, size: int, table: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, f: how often the n-grams of a size occur, those whose parts are in the table (None: all)."""
    sent = chunks.sparkSession.sparkContext.broadcast(table)

    def summed(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if parts:
            got = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
            yield from got.rename_columns(["lang", "phrase", "n"]).combine_chunks().to_batches(max_chunksize=1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            langs, own = batch.column("lang"), batch.column("own").to_numpy()
            row, phrases = _grams(batch.column("_chunk"), own, _lang_hashes(langs), size, sent.value)
            held.append(pa.table({"lang": langs.take(pa.array(row)), "phrase": phrases, "n": batch.column("n").take(pa.array(row))}))
            rows += row.size
            if rows >= GRAMS:
                yield from summed(held)
                held, rows = [], 0
        yield from summed(held)

    rows = chunks.select("lang", F.concat("chunk", F.lit("\n")).alias("_chunk"), "own", "n")
    return map_batches(rows, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def bit_table(grams: DataFrame, size: int) -> np.ndarray:
    """A set bit for the hash of each row (lang, phrase of ``size`` words).

    The bits are put together on the executors, 64 in a number; the driver
    gets MOST_BITS / 8 bytes at most.
    """
    bits = min(max(1 << int(grams.count() * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _, _ = _words(sh.bytes_of(batch.column("_phrase"))[0])
            slot = sh.mix(sh.rolled(hashes, size)[::size] ^ _lang_hashes(batch.column("lang"))) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["word", "mask"])

    found = map_batches(grams.select("lang", F.concat("phrase", F.lit("\n")).alias("_phrase")), run, "word long, mask long")
    rows = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return table.view(np.uint8)


def frequent(chunks: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, f of all phrases of up to ``longest`` words that occur at least ``least`` times."""
    every, table = None, None
    for size in range(1, longest + 1):
        found = staged(counted(chunks, size, table).filter(F.col("f") >= least).select("lang", F.lit(size).alias("size"), "phrase", "f"))
        every = found if every is None else every.unionByName(found)
        if size < longest:
            table = bit_table(found, size)
    return every


def scored(grams: DataFrame, longest: int = LONGEST, contained: int = CONTAINED) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate stands for.

    A cut's parts are looked up among the frequent phrases: they occur at least
    as often as the phrase. A phrase of one word less inside a longer one is
    the only kind to compare: any in between occurs at least as often.
    """
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    words = F.split("phrase", " ")
    cuts = (grams.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), salt.alias("salt"), words.alias("words"))
            .select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "size", "phrase", "a", "salt", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right")))
    # one word may be a part of many candidates: each part's row stands once in every salt
    parts = staged(grams.filter(F.col("size") < longest).select("lang", "phrase", "f"))
    part = lambda c, n: parts.select("lang", F.col("phrase").alias(c), F.col("f").alias(n), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    full = staged(cuts.join(part("left", "l"), ["lang", "salt", "left"]).join(part("right", "r"), ["lang", "salt", "right"]))
    exact = "decimal(15, 0)"
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * cast(a as {exact}) * cast(a as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    lowest = full.withColumn("score", score).groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    covers = lambda f: 100 * F.col("a") >= contained * F.col(f)
    inner = full.filter((F.col("k") == 1) & (F.col("size") > 2) & covers("r")).select("lang", F.col("right").alias("phrase")).union(
        full.filter((F.col("k") == F.col("size") - 1) & (F.col("size") > 2) & covers("l")).select("lang", F.col("left").alias("phrase")))
    return lowest.join(inner.distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int | None = TOP,
                 period: int = PERIOD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language (None: all)."""
    chunks = staged(dictionary(docs, text, lang, longest, period))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    best = scored(frequent(chunks, longest, least), longest)
    ranked = first_rows(best, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
