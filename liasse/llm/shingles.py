"""Words and word shingles of whole texts as 64-bit hashes, batch by batch.

A word is a run of letters, marks, digits and underscores of the lower-cased
text. A text of fewer words than a shingle has one shingle of all its words; a
text without words has none. Hashes depend on the text alone, so every task
gets the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 5
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: Column) -> Column:
    """The words of a text, each followed by one space; null counts as empty."""
    return F.concat(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", " "), F.lit(" "))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


_BREAK = np.arange(256) == 32


def _hash_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each run of bytes that aren't breaks."""
    inside = ~breaks[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not starts.size:
        return np.empty(0, np.uint64), starts
    lead = int(starts[0])
    spot = np.arange(lead, data.size) - np.repeat(starts, np.diff(np.append(starts, data.size)))
    worth = _BYTE[data[lead:]] * (spot.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    worth = np.where(inside[lead:], worth ^ (worth >> np.uint64(29)), np.uint64(0))
    return mix(np.add.reduceat(worth, starts - lead)), starts


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each row begins (one entry more than rows)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return data, ends - ends[0]


def segments(column: pa.Array, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and starts of all runs without break bytes, and where each row's runs begin.

    Every row must end with a break. The bytes are gone through in pieces that
    end at a break, so that beside the column itself only the hashes grow with
    a very long text.
    """
    data, ends = bytes_of(column)
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < data.size:
        stop = min(at + PIECE, data.size)
        while stop < data.size and not breaks[data[stop - 1]]:
            near = np.flatnonzero(breaks[data[stop : stop + PIECE]])
            stop = stop + int(near[0]) + 1 if near.size else min(stop + PIECE, data.size)
        h, s = _hash_piece(data[at:stop], breaks)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    places = np.concatenate(starts)
    return np.concatenate(hashes), places, np.searchsorted(places, ends)


def counted(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in the table; no row may be empty."""
    return np.add.reduceat(table[data], ends[:-1], dtype=np.int64) if data.size else np.zeros(ends.size - 1, np.int64)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of ``plain_words``, and where each row's words begin (one entry more than rows)."""
    hashes, _, bounds = segments(column)
    return hashes, bounds


def rolled(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One hash for each run of exactly ``size`` words, whatever text they are of."""
    out = np.zeros(max(words.size - size + 1, 0), np.uint64)
    for j in range(size):
        out = mix(out + _STEP) + words[j : j + out.size]
    return mix(out)


def shingle_rows(words: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The shingles of every row, in order of the text."""
    every = rolled(words, size)
    return [every[a : b - size + 1] if b - a >= size else rolled(words[a:b], b - a)[: int(b > a)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def column_shingles(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    return shingle_rows(*hashed_words(column), size)


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and how often each occurs."""
    keys, counts = np.unique(shingles, return_counts=True)
    return keys, counts.astype(np.float64)
