"""Alignment of two tokenizers' tokens over the bytes of each text.

Each side's tokens tile the bytes of a space and the text. Per batch,
``pandas.merge_asof`` keyed by document finds for each token start the other
side's covering token, in both directions; the union of both are the
overlapping pairs. Pairs that end on the same byte are links, and their ends
cut the tokens of both sides into groups.

How often an id pair is linked is counted over the corpus. Pairs that make up
more than one in ``HOT`` of the rows are at most ``HOT`` and are broadcast;
the others are joined by a shuffle.

Results for odd input: null and empty texts, and texts whose tokens' bytes
aren't those of a space and the text on either side, have no tokens: zeros and
an empty digest; texts of any length are encoded whole; null and repeated ids
are kept row by row; an empty table gives an empty one; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse.llm.batches import map_batches
from liasse.session import staged

MAX_MODEL = 64 << 20
BATCH_BYTES = 1 << 20
HOT = 10_000
SHIFT = 32
#: fixed value: how byte-level tokenizers cut texts
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL + 1)
    if len(raw) > MAX_MODEL:
        raise ValueError(f"{path} is over {MAX_MODEL} bytes")
    return raw


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library.

    A file of the plain form is run by the tiktoken library, which needs about
    half the time and gives the same ids: such a file cuts texts by
    ``BYTE_LEVEL_PATTERN``, and where ids rise with the merges, the pair that
    makes up a token is always the one that its merge names.
    """

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_buffer(raw)
        self.coder.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.coder.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.tokens[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.fast = self._fast(json.loads(raw))

    def _fast(self, file: dict):
        model, cut = file["model"], file["pre_tokenizer"] or {}
        plain = (file["normalizer"] is None and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "unk_token"))
                 and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                 and all(t["special"] for t in file["added_tokens"]))
        special = {t["id"] for t in file["added_tokens"]}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if not plain or any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        import tiktoken

        ranks = {token: i for i, token in enumerate(self.tokens) if i not in special}
        return tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(made) + 256 else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A model of the sentencepiece library, which puts the space before a text itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.tokens = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=1)
def _coders(a: bytes, b: bytes):
    """Kept by a worker process from task to task."""
    return ByteLevel(a), Pieces(b)


def spans(ids: list[np.ndarray], lengths: np.ndarray) -> pd.DataFrame:
    """doc, start, end and id of all tokens of the documents; bytes are counted on over the documents."""
    doc = np.repeat(np.arange(len(ids)), [i.size for i in ids])
    every = np.concatenate([np.empty(0, np.int64), *ids])
    end = np.cumsum(lengths[every])
    return pd.DataFrame({"doc": doc, "start": end - lengths[every], "end": end, "id": every})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """no_a, no_b: the rows of all pairs of tokens that overlap, each once.

    The token of either side that covers a token's start overlaps it, and of
    two that overlap one covers the other's start; both do if they start
    together, and then the first direction has the pair.
    """
    left = [t[["doc", "start"]].assign(**{no: np.arange(len(t))}) for t, no in ((a, "no_a"), (b, "no_b"))]
    ahead, back = (pd.merge_asof(x, y, on="start", by="doc")[["no_a", "no_b"]] for x, y in (left, left[::-1]))
    new = a["start"].to_numpy()[back["no_a"]] != b["start"].to_numpy()[back["no_b"]]
    return pd.concat([ahead, back[new]], ignore_index=True)


def _decimals(n: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}".encode() for i in range(n)], object)


class Aligner:
    def __init__(self, a, b):
        self.a, self.b = a, b
        self.lengths = [np.array([len(t) for t in side.tokens], np.int64) for side in (a, b)]
        self.names = [(_decimals(len(side.tokens), ","), _decimals(len(side.tokens), mark)) for side, mark in ((a, "|"), (b, ";"))]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a text's bytes don't come back from both."""
        out: tuple = ([], [])
        for text, *both in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            whole = (" " + text).encode()
            good = bool(text) and all(b"".join(map(side.tokens.__getitem__, ids)) == whole for side, ids in zip((self.a, self.b), both, strict=True))
            for side, ids in zip(out, both, strict=True):
                side.append(np.array(ids if good else [], np.int64))
        return out

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """Of each text: token counts, groups, links, linked id pairs and their counts, groups in writing."""
        ids = self.tokens(texts)
        a, b = (spans(i, n) for i, n in zip(ids, self.lengths, strict=True))
        met = overlaps(a, b)
        no_a, no_b = met["no_a"].to_numpy(), met["no_b"].to_numpy()
        together = a["end"].to_numpy()[no_a] == b["end"].to_numpy()[no_b]
        no_a, no_b = no_a[together], no_b[together]
        last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last[0][no_a], last[1][no_b] = True, True
        pairs = (a["id"].to_numpy()[no_a] << SHIFT) | b["id"].to_numpy()[no_b]
        doc = a["doc"].to_numpy()[no_a]
        order = np.argsort(doc, kind="stable")
        pairs, cuts = pairs[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))
        ends = [np.concatenate([[0], np.cumsum([i.size for i in side])]) for side in ids]
        names = self._written(a, b, *last)
        for i in range(len(texts)):
            own, times = np.unique(pairs[cuts[i] : cuts[i + 1]], return_counts=True)
            (x, y), (p, q) = ((int(e[i]), int(e[i + 1])) for e in ends)
            yield y - x, q - p, int(last[0][x:y].sum()), int(times.sum()), own, times, b"".join(names[x + p : y + q].tolist())[:-1]

    def _written(self, a: pd.DataFrame, b: pd.DataFrame, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
        """``a1,a2|b1;a3|b2,b3;`` token by token, over all documents: each group's tokens of one side, then those of the other."""
        out = np.empty(len(a) + len(b), object)
        first_b, upto_a = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (last_b, last_a))  # where groups begin
        for tokens, last, names, shift in ((a, last_a, self.names[0], first_b), (b, last_b, self.names[1], upto_a[1:])):
            group = np.cumsum(last) - last
            ids = tokens["id"].to_numpy()
            out[np.arange(len(tokens)) + shift[group]] = np.where(last, names[1][ids], names[0][ids])
        return out


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, about BATCH_BYTES at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, model_a: bytes, model_b: bytes, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, linked id pairs (a << 32 | b) and how often each is linked.

    With ``keep_groups`` also the groups in writing.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model_a, model_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Aligner(*_coders(*sent.value))
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("_text").to_pylist()):
                na, nb, groups, links, own, times, writing = zip(*one.align(texts), strict=True)
                lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)),
                                                               pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
                columns = [batch.column("doc_id").slice(at, len(texts)), *(pa.array(c, pa.int64()) for c in (na, nb, groups, links)),
                           pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in writing], pa.string()), lists(own), lists(times)]
                names = [c.split()[0] for c in _FOUND.split(", ")]
                if keep_groups:
                    columns, names = [*columns, pa.array([w.decode() for w in writing], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return map_batches(rows, run, _FOUND + (", groups string" if keep_groups else ""))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), rows (in how many rows it stands), best (whether no other pair of its B id has more)."""
    counts = staged(links.groupBy("pair").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows")))
    side = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    top = counts.groupBy(side.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", side).join(top, "b").select("pair", "n", "rows", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, model_a: bytes, model_b: bytes, text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    found = staged(aligned(docs, model_a, model_b, text).withColumn("row", F.monotonically_increasing_id()))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = staged(pair_counts(links))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    # at most ``hot`` pairs can have more than one in ``hot`` of all rows
    common = F.broadcast(counts.filter(F.col("rows") * hot > total).select("pair", F.col("n").alias("_n"), F.col("best").alias("_best")))
    met = links.join(common, "pair", "left")
    worth = lambda n, best: (F.sum(F.when(best, F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * n).alias("count_sum"))
    rest = counts.filter(F.col("rows") * hot <= total)
    sums = met.filter("_n is not null").groupBy("row").agg(*worth(F.col("_n"), F.col("_best"))).unionByName(
        met.filter("_n is null").select("row", "pair", "times").join(rest, "pair").groupBy("row").agg(*worth(F.col("n"), F.col("best"))))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
