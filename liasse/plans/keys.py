"""Which of very many strings a text may hold: one key per string, and a bit table of the keys in front of the join.

Each string is stood for by the hash of one window of its bytes, ``SIZES``
long as the string allows: the one that the fewest strings of its case share.
A task hashes all windows of its texts and passes on those alone that the bit
table knows, so what is shuffled grows with the hits and not with the length
of the texts. The table has ``BITS_EACH`` bits for a key and ``MOST_BITS`` at
most; it may let others pass, and the join on the key and the test of the
string sort these out. It never holds back a string that is there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liasse.session import staged

SIZES = (4, 8, 12, 16)
BITS_EACH = 24
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: bytes of texts whose windows are hashed at once
PIECE = 1 << 18
KEY = "_key"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _windows(data: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the hash of the window that begins at each byte; a longer one is made of two shorter ones."""
    both = lambda a, b, by: _mix(a[: max(b.size - by, 0)] * _ODD + b[by:])
    one = _BYTE[data]
    two = both(one, one, 1)
    found = {4: both(two, two, 2)}
    if max(sizes) >= 8:
        found[8] = both(found[4], found[4], 4)
    if 12 in sizes:
        found[12] = both(found[8], found[4], 8)
    if 16 in sizes:
        found[16] = both(found[8], found[8], 8)
    for size in sizes:
        yield size, found[size]


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [keys & mask, (keys >> np.uint64(34)) & mask, _mix(keys ^ _ODD) & mask]


def _known(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys the table may hold; later places are looked up only where the earlier ones are set."""
    at = np.arange(keys.size)
    for i in range(3):
        place = _places(keys[at], table.size * 8)[i] if i else keys[at] & np.uint64(table.size * 8 - 1)
        at = at[(table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each row begins (one entry more than rows); null counts as empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _row_keys(column: pa.Array, case: np.ndarray, sizes: Sequence[int], table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the windows of a column of strings, each key once per row.

    With a table only those it knows; without one the windows of each row's own size.
    """
    data, ends = _bytes_of(column)
    length = np.diff(ends)
    own = np.select([length >= s for s in SIZES[::-1]], SIZES[::-1], 0)
    at = 0
    while at < length.size:
        upto = max(int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1, at + 1)
        row = np.repeat(np.arange(at, upto), length[at:upto])
        left = ends[row + 1] - ends[at] - np.arange(row.size)
        rows, keys = [], []
        for size, hashes in _windows(data[ends[at] : ends[upto]], sizes):
            whole = np.flatnonzero((left[: hashes.size] >= size) if table is not None else (left[: hashes.size] >= size) & (own[row[: hashes.size]] == size))
            key = _mix(hashes[whole] + case[row[whole]] * np.uint64(size * 2 + 1))
            if table is not None:
                some = _known(key, table)
                whole, key = whole[some], key[some]
            rows.append(row[whole])
            keys.append(key)
        rows, keys = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])[: rows.size]
        yield rows[new], keys[new]
        at = upto


def _case(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys).alias("_case")


def own_keys(strings: DataFrame, keys: Sequence[str], string: str) -> DataFrame:
    """Each distinct string of ``SIZES[0]`` bytes or more with its key; staged, as table and join both read it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            case = batch.column("_case").to_numpy().view(np.uint64)
            for rows, found in _row_keys(batch.column(string), case, SIZES):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in names), pa.array(found.view(np.int64))], [*names, KEY])

    distinct = strings.select(*keys, string).distinct()
    names = distinct.columns
    spread = distinct.withColumn("_case", _case(keys)).mapInArrow(run, T.StructType([*distinct.schema.fields, T.StructField(KEY, T.LongType())]))
    shared = spread.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    return staged(spread.join(shared, KEY).groupBy(*names).agg(F.min(F.struct("_n", KEY))[KEY].alias(KEY)))


def bit_table(rows: DataFrame, n: int, key: str = KEY) -> np.ndarray:
    """The bit table of a column of ``n`` keys, put together from the tasks' words; at most ``MOST_BITS``."""
    bits = min(max(1 << (BITS_EACH * n).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        some = np.flatnonzero(words)
        for at in range(0, some.size, 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part])], ["at", "word"])

    words = rows.select(key).mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return table.view(np.uint8)


def _repeated(batch: pa.RecordBatch, names: Sequence[str], rows: np.ndarray, more: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in names), more], [*names, name])


def candidates(texts: DataFrame, keyed: DataFrame, keys: Sequence[str], text: str, string: str) -> DataFrame:
    """Rows of ``texts`` once for each key of ``keyed`` that they may hold."""
    size = F.greatest(*[F.when(F.octet_length(string) >= s, s) for s in SIZES], F.lit(SIZES[0]))
    n, sizes = keyed.agg(F.count(F.lit(1)), F.collect_set(size)).first()
    sizes = sorted(sizes) or [SIZES[0]]
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(keyed, n))
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            case = batch.column("_case").to_numpy().view(np.uint64)
            for rows, found in _row_keys(batch.column(text), case, sizes, sent.value):
                if rows.size:
                    yield _repeated(batch, names, rows, pa.array(found.view(np.int64)), KEY)

    return texts.withColumn("_case", _case(keys)).mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(KEY, T.LongType())]))


def with_known(texts: DataFrame, patterns: DataFrame, keys: Sequence[str], words: Column, word: str) -> DataFrame:
    """Rows of ``texts`` once for each of their ``words`` that a pattern of their case may have."""
    hashed = staged(patterns.select(F.xxhash64(*keys, word).alias(KEY)).distinct())
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(hashed, hashed.count()))
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hashes = batch.column("_words"), batch.column("_hashes").flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            some = _known(hashes.to_numpy().view(np.uint64), sent.value)
            if some.size:
                yield _repeated(batch, names, row[some], lists.flatten().take(pa.array(some)), word)

    full = texts.withColumn("_words", words).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(*keys, w)))
    return full.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(word, T.StringType())]))
