"""Improbable-feature digests of whole texts, and their likeness.

Every window of ``WINDOW`` bytes has an entropy, kept as the sum of c log2 c
over its byte counts in whole units and followed along the text by what leaves
and what enters. Windows are ranked by how rare their class of entropy is in
the whole corpus; classes too even to tell anything come last. Along the
text, each run of ``RUN`` windows votes for its best-ranked one (the first of
equals); a window with ``VOTES`` votes is a feature, and if there is none, the
best-ranked window of the text. Distinct features go, in order of the text,
into Bloom filters of ``BITS`` bits with ``HASHES`` bits each; a filter that
has ``FEATURES`` of them is followed by another one.

Likeness holds each filter of the shorter chain against all of the other one,
takes the best normalised bit overlap (0 where it isn't ``SIGMA`` deviations
above what chance gives, 1 where the smaller filter is contained) and weighs
them by their bits; chains of one length are compared both ways.

Results for odd input: null text counts as empty and has an empty fingerprint;
two empty fingerprints are alike (1), an empty one and another aren't (0); a
text shorter than a window is one feature; long texts are read in pieces;
equal texts have equal fingerprints; in the order by doc_id null ids come
last, equal ids go by the text's hash; repeated rows follow each other; a
single row is its own next; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse.llm import shingles as sh
from liasse.llm.batches import map_batches
from liasse.session import staged

WINDOW = 32
RUN = 32
VOTES = 8
CLASSES = 256
EVEN = 96  # classes below have under 3/8 of the largest entropy: a few symbols over and over
BITS = 2048
HASHES = 5
FEATURES = 128
SIGMA = 2.0
PIECE = 1 << 18
BLOCK = 64
_UNIT = 1 << 16
_WORTH = np.array([0, *(round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1))], np.int64)
_FAR = np.int64(1) << 62
_MULT = sh.mix(np.arange(WINDOW, dtype=np.uint64) + np.uint64(11)) | np.uint64(1)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class (0 to CLASSES - 1, by entropy) of the window that starts at each byte, for all whole windows."""
    n = data.size - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ahead, behind = np.ones(data.size, np.uint8), np.ones(data.size, np.uint8)
    for d in range(1, WINDOW):  # how often a byte is met again in a window that begins, or ends, with it
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    step = np.diff(_WORTH, prepend=0)
    total = np.empty(n, np.int64)
    total[0] = _WORTH[np.bincount(data[:WINDOW], minlength=256)].sum()
    total[1:] = step[behind[WINDOW:]] - step[ahead[: n - 1]]
    return (_WORTH[WINDOW] - np.cumsum(total)) * (CLASSES - 1) // _WORTH[WINDOW]


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray, own: tuple[int, int] | None = None):
    """Places of the features, in order, and the best-ranked place of every text (-1 without a window).

    ``own``: only features between these places count; the piece must reach
    RUN - 1 windows beyond on both sides, or to the end of its text.
    """
    classes = entropy_classes(data)
    best = np.full(starts.size, -1, np.int64)
    sizes = np.maximum(ends - starts - WINDOW + 1, 0)
    some = np.flatnonzero(sizes)
    if not some.size:
        return np.empty(0, np.int64), best
    places = np.arange(classes.size)
    inside = np.zeros(data.size + 1, np.int64)
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, starts[some] + sizes[some], -1)
    inside = np.cumsum(inside)[: classes.size] > 0
    key = np.where(inside, (ranks[classes] << np.int64(40)) | places, _FAR)
    best[some] = np.minimum.reduceat(key, np.stack([starts[some], starts[some] + sizes[some]], 1).ravel()[: 2 * some.size - (starts[some[-1]] + sizes[some[-1]] >= key.size)])[::2] & ((1 << 40) - 1)
    low, width = key, 1
    while width < RUN:
        low = np.minimum(low[:-width], low[width:]) if low.size > width else low[:0]
        width *= 2
    full = np.zeros(data.size + 1, np.int64)  # runs that lie in one text
    runs = np.maximum(sizes[some] - RUN + 1, 0)
    np.add.at(full, starts[some], np.sign(runs))
    np.add.at(full, starts[some] + runs, -np.sign(runs))
    voting = np.cumsum(full)[: low.size] > 0
    votes = np.bincount((low[voting] & ((1 << 40) - 1)).astype(np.int64), minlength=classes.size)
    chosen = (votes >= VOTES) & (ranks[classes] < ranks[:EVEN].min())
    if own:
        chosen &= (places >= own[0]) & (places < own[1])
    return np.flatnonzero(chosen), best


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64 bits for the window at each place."""
    out = np.zeros(places.size, np.uint64)
    for i in range(WINDOW):
        out = out * np.uint64(0x100000001B3) + sh._BYTE[data[places + i]] * _MULT[i]
    return sh.mix(out)


def _filters(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters as rows of BITS / 8 bytes, from features in order of the text."""
    _, first = np.unique(hashes, return_index=True)
    distinct = hashes[np.sort(first)]
    count = -(-distinct.size // FEATURES)
    bits = np.zeros(count * BITS, np.uint8)
    base = np.arange(distinct.size) // FEATURES * BITS
    for k in range(HASHES):
        bits[base + ((distinct >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).reshape(count, BITS // 8)


def _long(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Feature hashes of one long text, in pieces."""
    n, found, lowest = data.size - WINDOW + 1, [], (np.int64(_FAR), 0)
    for at in range(0, n, PIECE):
        begin, stop = max(at - RUN + 1, 0), min(at + PIECE + RUN - 1 + WINDOW - 1, data.size)
        part = data[begin:stop]
        here, best = _features(part, np.array([0]), np.array([part.size]), ranks, (at - begin, min(at + PIECE, n) - begin))
        found.append(_hashes(part, here))
        key = (ranks[entropy_classes(part[best[0] : best[0] + WINDOW])[0]], begin + int(best[0]))
        lowest = min(lowest, key)
    every = np.concatenate(found)
    return every if every.size else _hashes(data, np.array([lowest[1]]))


def fingerprints(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, many short texts at a time."""
    out: list = [np.empty((0, BITS // 8), np.uint8)] * len(texts)
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(b for _, b in group), np.uint8)
        sizes = np.array([len(b) for _, b in group])
        ends = np.cumsum(sizes)
        places, best = _features(data, ends - sizes, ends, ranks)
        own = np.searchsorted(places, ends)
        for (i, raw), a, b, only in zip(group, np.concatenate([[0], own[:-1]]), own, best, strict=True):
            if only < 0:
                out[i] = _filters(np.frombuffer(hashlib.md5(raw).digest()[:8], "<u8"))
            else:
                out[i] = _filters(_hashes(data, places[a:b] if b > a else np.array([only])))

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) > PIECE:
            out[i] = _filters(_long(np.frombuffer(raw, np.uint8), ranks))
        elif raw:
            group.append((i, raw))
            held += len(raw)
            if held >= PIECE:
                flush()
                group, held = [], 0
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 for two chains of filters."""
    if not a.shape[0] or not b.shape[0]:
        return float(a.shape[0] == b.shape[0])
    if a.shape[0] == b.shape[0] and (a == b).all():
        return 1.0
    if a.shape[0] == b.shape[0]:
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if a.shape[0] < b.shape[0] else _one_way(b, a)


def _one_way(a: np.ndarray, b: np.ndarray) -> float:
    wa, wb = a.view(np.uint64), b.view(np.uint64)
    na, nb = (np.bitwise_count(w).sum(axis=1, dtype=np.float64) for w in (wa, wb))
    got = np.empty(na.size)
    for i in range(0, na.size, BLOCK):
        ones, top = na[i : i + BLOCK, None], np.zeros(min(BLOCK, na.size - i))
        for j in range(0, nb.size, BLOCK):
            twos = nb[None, j : j + BLOCK]
            both = np.bitwise_count(wa[i : i + BLOCK, None] & wb[None, j : j + BLOCK]).sum(axis=2, dtype=np.float64)
            chance, most = ones * twos / BITS, np.minimum(ones, twos)
            floor = chance + SIGMA * np.sqrt(chance * (1 - ones / BITS) * (1 - twos / BITS))
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(both >= most, 1.0, np.where(floor < most, (both - floor) / (most - floor), 0.0))
            top = np.maximum(top, share.max(axis=1))
        got[i : i + BLOCK] = top
    return float(np.clip((got * na).sum() / na.sum(), 0, 1))


def written(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each class of entropy, 0 for the rarest one over all windows of all texts; even classes after all others.

    The executors send one count per class and task; the driver gets CLASSES numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, np.int64)
        for batch in batches:
            data, ends = sh.bytes_of(batch.column("_text"))
            whole = np.repeat(ends[1:], np.diff(ends))  # where the text of a byte ends
            for at in range(0, data.size, PIECE):
                part = entropy_classes(data[at : at + PIECE + WINDOW - 1])
                start = np.arange(at, at + part.size)
                seen += np.bincount(part[start + WINDOW <= whole[at : at + part.size]], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(seen)], ["k", "n"])

    rows = map_batches(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")), run, "k long, n long")
    seen = np.zeros(CLASSES, np.int64)
    for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect():
        seen[r["k"]] = r["n"]
    return ranked(seen)


def ranked(seen: np.ndarray) -> np.ndarray:
    """Ranks from counts: rarer first, of equal ones the higher entropy, even classes last."""
    k = np.arange(CLASSES)
    order = np.lexsort((-k, seen, k < EVEN))
    out = np.empty(CLASSES, np.int64)
    out[order] = k
    return out


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the head of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _answer(doc_id, text: str, own: np.ndarray, changed: str, other: np.ndarray, following: np.ndarray) -> tuple:
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(other),
            likeness(own, other), likeness(own, following))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared_with_next(docs: DataFrame, text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The rows are dealt out by ranges of (doc_id, hash of the text); a task goes
    through its range in order with one row held back. The first and the last
    row of each range are joined afterwards, by the number of the range. The
    driver gets one number per range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ranks is None:
        ranks = rarity(base)
    sent = spark.sparkContext.broadcast(ranks)
    names = [c.split()[0] for c in _ROW.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        kinds, cols = [*_KINDS, pa.string(), pa.string(), pa.int64()], [*names, "text", "kind", "part"]
        blank = (None,) * 4
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not texts:
                continue
            own, rows = fingerprints(texts, sent.value), []
            if held is None:
                rows.append((ids[0], None, None, written(own[0]), *blank[:3], texts[0], "head", part))
                line = list(zip(ids, texts, own, strict=True))
            else:
                line = [held, *zip(ids, texts, own, strict=True)]
            changed = [edited(a[1], b[1]) for a, b in zip(line, line[1:], strict=False)]
            for a, b, c, f in zip(line, line[1:], changed, fingerprints(changed, sent.value), strict=False):
                rows.append((*_answer(*a, c, f, b[2]), None, "done", part))
            held = line[-1]
            yield _batch(rows, cols, kinds)
        if held is not None:
            yield _batch([(held[0], None, None, written(held[2]), *blank[:3], held[1], "tail", part)], cols, kinds)

    line = base.withColumn("_key", F.xxhash64("text")).repartitionByRange(F.asc_nulls_last("doc_id"), F.asc("_key"))
    line = line.sortWithinPartitions(F.asc_nulls_last("doc_id"), F.asc("_key"), F.asc("text")).select("doc_id", "text")
    walked = staged(map_batches(line, walk, _ROW + ", text string, kind string, part long"), codec="zstd")
    parts = sorted(r["part"] for r in walked.filter("kind = 'head'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, _next long")
    heads = walked.filter("kind = 'head'").select(F.col("part").alias("_next"), F.col("text").alias("_text"), F.col("fingerprint").alias("_print"))
    tails = walked.filter("kind = 'tail'").select("doc_id", "text", "fingerprint", "part").join(follows, "part").join(heads, "_next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, prints, after, after_print = (batch.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "_text", "_print"))
            changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
            rows = [_answer(i, t, read(p), c, f, read(q)) for i, t, p, c, f, q in zip(
                ids, texts, prints, changed, fingerprints(changed, sent.value), after_print, strict=True)]
            yield _batch(rows, names, _KINDS)

    ends = map_batches(tails.select("doc_id", "text", "fingerprint", "_text", "_print"), finish, _ROW)
    return walked.filter("kind = 'done'").select(*names).unionByName(ends)
