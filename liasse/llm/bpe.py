"""Byte-level BPE: texts to token ids and back.

A piece of text is merged on a segment tree over its byte positions. A leaf
holds the rank of the pair that starts at the position, an inner node the
smallest rank below it and, among equal ones, the leftmost position. The root
names the next merge; a merge changes the leaves of the two live neighbours
and of the symbol that vanished, each in logarithmic time.

The vocabulary (at most ``MAX_VOCABULARY`` bytes) is read on the driver and
sent to the tasks. Ids are little-endian unsigned 32-bit integers in one
binary value per text.

Results for odd input: null text counts as empty and gives no ids; texts of
any length are encoded whole; ids unknown to the vocabulary fail the job; rows
are neither dropped nor merged; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse.llm.batches import map_batches

MAX_VOCABULARY = 64 << 20
LONG_TEXT = 1 << 20
CACHED_PIECE = 64
CACHED_PIECES = 400_000
ROWS_OUT = 256
_NONE = (1 << 62) - 1
_SHIFT = 36
_PLACE = (1 << _SHIFT) - 1


def read_vocabulary(path: str) -> bytes:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{path} is over {MAX_VOCABULARY} bytes")
    return raw


def parse_vocabulary(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of one piece; ``longest`` is the length of the longest token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    after, before, get = list(range(1, n + 2)), list(range(-1, n)), ranks.get
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = (rank << _SHIFT) | i
    for at in range(width - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right
    while (top := tree[1]) != _NONE:
        i = top & _PLACE
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        changed = [(gone, _NONE)]
        for j in (i, before[i]):  # the pairs that the new symbol begins and ends
            if j >= 0:
                mid = after[j]
                stop = after[mid] if mid < n else 0
                rank = get(piece[j:stop]) if 0 < stop <= j + longest else None
                changed.append((j, _NONE if rank is None else (rank << _SHIFT) | j))
        for j, low in changed:
            at = j + width
            tree[at] = low
            while at > 1:
                other = tree[at ^ 1]
                if other < low:
                    low = other
                at >>= 1
                if tree[at] == low:
                    break
                tree[at] = low
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Packed ids of each piece met so far; emptied when it has ``CACHED_PIECES``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        # rank files mean Unicode white space, regex's own \\s has four control characters more
        self.ranks, self.pattern = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.longest = max(map(len, ranks), default=1)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8"), self.ranks, self.longest), "<u4").tobytes()
        if len(piece) <= CACHED_PIECE:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def pack(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found, parts = self.pattern.finditer(text), []
        while some := b"".join(self[m.group()] for m in islice(found, 100_000)):
            parts.append(some)
        return b"".join(parts)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}

    def unpack(self, ids: bytes) -> bytes:
        every = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, every[i : i + LONG_TEXT].tolist()))
                        for i in range(0, every.size, LONG_TEXT))


@functools.lru_cache(maxsize=1)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    """Kept by a worker process from task to task."""
    return Encoder(parse_vocabulary(raw), pattern)


@functools.lru_cache(maxsize=1)
def _decoder(raw: bytes) -> Decoder:
    return Decoder(parse_vocabulary(raw))


def _mapped(df: DataFrame, source: str, targets: list[str], worker) -> DataFrame:
    """``df`` with binary columns from ``worker() -> (value -> values)`` in place of the source column.

    Rows go out in groups of ``ROWS_OUT``, so that a task holds the results of few texts.
    """
    kept = [f for f in df.schema.fields if f.name != source]
    rest = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = worker()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(i, ROWS_OUT)
                made = list(zip(*(one(v.as_py()) for v in part.column(source)), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(m, pa.binary()) for m in made)], [*rest, *targets])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{t}` binary" for t in targets])
    return map_batches(df, run, schema)


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The text column replaced by its packed ids."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def worker():
        coder = _encoder(sent.value, pattern)
        return lambda t: (coder.pack(t or ""),)

    return _mapped(df, text, [ids], worker)


def decode(df: DataFrame, vocabulary: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the packed ids stand for."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def worker():
        coder = _decoder(sent.value)
        return lambda b: (coder.unpack(b or b""),)

    return _mapped(df.withColumn("_ids", F.col(ids)), "_ids", [out], worker)


def round_trip(df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The text column replaced by its packed ids and by what they decode to, in one pass."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def worker():
        coder, back = _encoder(sent.value, pattern), _decoder(sent.value)

        def both(t):
            packed = coder.pack(t or "")
            return packed, back.unpack(packed)

        return both

    return _mapped(df, text, [ids, out], worker)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """doc_id, token count and SHA-256 of the packed ids and of the decoded bytes, and the columns ``keep``."""
    return df.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(F.col(ids), 256).alias("ids_sha256"),
                     F.sha2(F.col(decoded), 256).alias("decoded_sha256"), *(keep or []))
