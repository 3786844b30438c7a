"""Toxicity scores from character n-grams with naive Bayes feature scaling.

The words of a text, in lower case and with one space around each, are cut
into n-grams of the lengths in ``LENGTHS``, hashed to ``SLOTS`` features. A
feature's value is its count over the square root of the text's length, times
the log ratio of the shares of toxic and clean documents that have it. A
logistic model is fitted on these values.

It is fitted on the driver on at most ``MOST_TOXIC`` and ``MOST_CLEAN``
labelled documents of at most ``LONGEST`` bytes each and ``MOST_BYTES`` in all,
those whose ids have the smallest hashes. The model (one weight per feature kept) goes to the tasks;
scoring reads whole texts in pieces, so memory doesn't grow with a long text.

Results for odd input: null and empty texts get the score that the model's
bias alone gives; labels that are null, repeated or without a document are
left out of the fit (repeated ones count once, as toxic if one of them is);
repeated documents are scored each; without labels of both kinds the score is
the share of toxic labels, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liasse.llm import shingles as sh
from liasse.llm.batches import map_batches

LENGTHS = (3, 5, 7)
SLOTS = 1 << 20
KEPT = 20_000
LEAST_DOCUMENTS = 4
MOST_TOXIC = 1_200
MOST_CLEAN = 2_400
LONGEST = 100_000
MOST_BYTES = 48 << 20
FIT_ROWS = 256
THRESHOLD = 0.5
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def plain(text: Column) -> Column:
    return F.concat(F.lit(" "), F.ltrim(sh.plain_words(text)))


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, one array per length and piece."""
    longest = max(LENGTHS)
    for at in range(0, max(len(text), 1), PIECE):
        codes = np.frombuffer(text[at : at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rolling = codes
        for n in range(2, longest + 1):
            rolling = rolling[:-1] * _STEP + codes[n - 1 :]
            if n in LENGTHS:
                own = sh.mix(rolling[: PIECE] + np.uint64(n))
                yield (own & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Model:
    bias: float
    features: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros(SLOTS, np.float64)
        dense[self.features] = self.weights
        return dense


def raw_score(text: str, table: np.ndarray, bias: float) -> float:
    return bias + sum(float(table[g].sum()) for g in grams(text)) / max(len(text), 1) ** 0.5


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 300, rate: float = 0.05, shrink: float = 1e-4) -> Model:
    """Logistic regression by full-batch gradient steps with per-weight step sizes."""
    none = np.empty(0, np.int64)
    if not len(texts) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(texts) else 0.0
        return Model(-40.0 if share < 0.5 else 40.0, none, np.empty(0))
    # the texts are gone through twice, so that no table of all their n-grams is ever held
    seen = np.zeros((2, SLOTS), np.int32)
    for t, y in zip(texts, toxic, strict=True):
        seen[int(y), np.unique(np.concatenate([none, *grams(t)]))] += 1
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())
    ratio = np.log((seen[1] + 1) / (n_toxic + 2)) - np.log((seen[0] + 1) / (n_clean + 2))
    total = seen.sum(axis=0)
    worth = np.where(total >= LEAST_DOCUMENTS, np.abs(ratio) * np.sqrt(total), 0)
    kept = np.sort(np.argsort(-worth, kind="stable")[:KEPT])
    kept = kept[worth[kept] > 0]
    place = np.full(SLOTS, -1, np.int32)
    place[kept] = np.arange(kept.size)
    blocks, square, n_values = [], 0.0, 0
    for at in range(0, len(texts), FIT_ROWS):
        rows, cols, values = [none], [none], [np.empty(0)]
        for i, text in enumerate(texts[at : at + FIT_ROWS]):
            every = np.concatenate([none, *grams(text)])
            features, counts = np.unique(every[place[every] >= 0], return_counts=True)
            rows.append(np.full(features.size, i))
            cols.append(place[features])
            values.append(ratio[features] * counts / max(len(text), 1) ** 0.5)
        value = np.concatenate(values)
        square, n_values = square + float((value * value).sum()), n_values + value.size
        blocks.append((at, np.concatenate(rows).astype(np.int16), np.concatenate(cols).astype(np.int32), value.astype(np.float32)))
    scale = 1 / max((square / n_values) ** 0.5, 1e-12) if n_values else 1.0
    w, b = np.zeros(kept.size), 0.0
    m, v = np.zeros(kept.size + 1), np.zeros(kept.size + 1)
    for step in range(1, rounds + 1):
        slope = np.append(shrink * w, 0.0)
        for at, row, col, value in blocks:
            own = toxic[at : at + FIT_ROWS]
            off = (sigmoid(np.bincount(row, value * w[col] * scale, own.size) + b) - own) / len(texts)
            slope[:-1] += np.bincount(col, value * off[row] * scale, kept.size)
            slope[-1] += off.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), kept, w * ratio[kept] * scale)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(id, label) of the rows to learn from, each id once."""
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    return ids.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], longest: int = LONGEST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, text, label): a sample of the labelled training rows, by the hash of their ids, bounded in rows and bytes."""
    once = training_labels(labels, label)
    parts = [once.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in sorted(most.items())]
    chosen = parts[0].union(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.octet_length("text") <= longest)
    # at most sum(most) rows of a few numbers
    sizes = texts.select("id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(
        F.max("n").alias("n"), F.xxhash64("id").alias("h")).orderBy("h", "id").collect()
    upto = np.searchsorted(np.cumsum([r["n"] for r in sizes]), most_bytes, "right")
    within = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in sizes[:upto]], "id long, label int")
    return texts.join(F.broadcast(within), "id").dropDuplicates(["id"])


def prior_shift(labels: DataFrame, label: str, sample: np.ndarray) -> float:
    """What to add to a bias so that it fits the labels' shares rather than the sample's."""
    total = {r["label"]: r["count"] for r in training_labels(labels, label).groupBy("label").count().collect()}
    ones, zeros = float(sample.sum()), float(sample.size - sample.sum())
    if not ones or not zeros:
        return 0.0
    return float(np.log(total[1] / total[0]) - np.log(ones / zeros))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    sample = labelled_sample(docs, labels, "toxic", {0: most_clean, 1: most_toxic})
    rows = sorted(sample.select("id", plain(F.col("text")).alias("t"), "label").collect())
    toxic = np.array([r["label"] for r in rows], np.float64)
    model = fit([r["t"] for r in rows], toxic)
    model.bias += prior_shift(labels, "toxic", toxic)
    return model


def scored(df: DataFrame, model: Model, keep: list[str], text: Column | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` of ``df``, and the probability of being toxic in the column ``out``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value.table(), sent.value.bias
        for batch in batches:
            scores = [float(sigmoid(raw_score(t.as_py(), table, bias))) for t in batch.column("_plain")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    return map_batches(df.select(*keep, plain(F.col("text") if text is None else text).alias("_plain")), run, schema)


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scored(narrow, train(docs, labels, **options), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't found toxic."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # no column of theirs can clash with the score
    found = scored(rows, train(docs, labels, **options), ["row"], F.col("row.text"))
    return found.filter(F.col("score") < THRESHOLD).select("row.*")
