"""Quality scores by compression with dictionaries of good and of bad text.

A zstandard dictionary is built from labelled good text and one from bad text.
A text is cut into blocks of ``BLOCK`` bytes, each is compressed with either
dictionary; the difference of the two sizes over the sum of both is the
text's measure: above 0, good text explains it better. A logistic curve of
the measure, fitted on the labelled sample, gives the score.

The dictionaries are built, and the curve is fitted, on the driver on at most
``MOST_BAD`` and ``MOST_GOOD`` labelled documents of at most ``LONGEST``
bytes, those whose ids have the smallest hashes. Half of them build the
dictionaries, the other half calibrate, so that no text is measured with its
own dictionary. The model (two dictionaries of ``DICTIONARY`` bytes at most)
goes to the tasks. Whole texts are scored.

Results for odd input: null and empty texts have measure 0 and get its score;
labels that are null, repeated or without a document are left out (repeated
ones count once, as good if one of them is); repeated documents are scored
each; without labels of both kinds, or with too few to build a dictionary,
the score is the share of good labels, or 1 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liasse.llm.batches import map_batches
from liasse.llm.toxicity import held_out, labelled_sample, prior_shift, sigmoid

BLOCK = 512
DICTIONARY = 1 << 16
LEVEL = 3
MOST_BAD = 3_000
MOST_GOOD = 4_000
LONGEST = 100_000
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    bias: float
    slope: float


class Measure:
    def __init__(self, good: bytes, bad: bytes):
        self.both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                              write_dict_id=False) for d in (good, bad)]

    def __call__(self, text: str) -> float:
        raw = text.encode("utf-8", "surrogatepass")
        g = b = 0
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            g += len(self.both[0].compress(part))
            b += len(self.both[1].compress(part))
        return (b - g) / (b + g) if raw else 0.0


def dictionary(texts: list[str]) -> bytes | None:
    parts = [raw[i : i + BLOCK] for raw in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(raw), BLOCK)]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, total // 8), parts).as_bytes() if total >= 4096 else None
    except zstandard.ZstdError:  # the library refuses samples that are too few or too alike
        return None


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope of a logistic regression with one feature, by Newton steps with a little shrinkage."""
    scale = max(float(x.std()), 1e-9)
    z, w = np.stack([np.ones_like(x), x / scale], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(texts: list[str], good: np.ndarray) -> Model:
    share = float(good.mean()) if len(texts) else 1.0
    flat = Model(b"", b"", float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0)
    half = np.arange(len(texts)) % 2 == 0
    made = {k: dictionary([t for t, y, h in zip(texts, good, half, strict=True) if h and y == k]) for k in (0, 1)}
    rest = ~half
    if None in made.values() or not rest.any() or good[rest].min() == good[rest].max():
        return flat
    measure = Measure(made[1], made[0])
    x = np.array([measure(t) for t, h in zip(texts, half, strict=True) if not h])
    return Model(made[1], made[0], *curve(x, good[rest]))


def train(docs: DataFrame, labels: DataFrame, most_bad: int = MOST_BAD, most_good: int = MOST_GOOD) -> Model:
    sample = labelled_sample(docs, labels, "quality", {0: most_bad, 1: most_good})
    rows = sorted(sample.select(F.xxhash64("id").alias("h"), "text", "label").collect())
    good = np.array([r["label"] for r in rows], np.float64)
    model = fit([r["text"] for r in rows], good)
    model.bias += prior_shift(labels, "quality", good)
    return model


def scored(df: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` of ``df``, and the probability of being good in the column ``out``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        measure = Measure(model.good, model.bad) if model.slope else (lambda t: 0.0)
        for batch in batches:
            x = np.array([measure(t.as_py() or "") for t in batch.column("_text")])
            made = pa.array(sigmoid(model.bias + model.slope * x), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    return map_batches(df.select(*keep, F.col(text).alias("_text")), run, schema)


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scored(narrow, train(docs, labels, **options), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
