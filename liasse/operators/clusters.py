"""Exact vector search that leaves out clusters which can't hold a hit.

Vectors are stored by the nearest of a few centres. A case's part of a cluster
is a ball: its radius is the largest distance of a vector to the centre. No
inner product with a vector of the ball exceeds that with the centre plus the
query's length times the radius. The balls with the highest bounds are
searched first; after that only balls whose bound reaches the k-th best score
so far are read. Centres come from a bounded sample of the vectors; every
vector is stored, and the hits don't depend on the centres.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liasse import rules
from liasse.operators import dense as scan
from liasse.plans.ordering import first_rows
from liasse.schemas import QUERY

MOST_CENTRES = 256
SAMPLE = 20_000
ROUNDS = 8
ROUNDING = 1e-6


@dataclass(frozen=True)
class Clustered:
    """``vectors``: case_id, chunk_ord, embedding, cluster; ``balls``: case_id, cluster, radius, n; the centres."""

    vectors: DataFrame
    balls: DataFrame
    centres: np.ndarray


def centres(vectors: DataFrame, dim: int, count: int, sample: int = SAMPLE) -> np.ndarray:
    """At most ``count`` centres of the ``sample`` vectors whose places have the smallest hashes."""
    rows = vectors.filter(F.size("embedding") == dim).orderBy(F.xxhash64("case_id", "chunk_ord"), "case_id", "chunk_ord").select("embedding").limit(sample).toPandas()
    v = scan._matrix(rows["embedding"]) if len(rows) else np.zeros((1, dim))
    c = v[:: max(1, len(v) // min(count, MOST_CENTRES))][: min(count, MOST_CENTRES)].copy()
    for _ in range(ROUNDS):
        near = (v @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        for k in np.unique(near):
            c[k] = v[near == k].mean(axis=0)
    return c


def build(vectors: DataFrame, path: str, count: int = 64) -> Clustered:
    """Store the vectors by cluster under ``path``; those of another dimension than the most are left out, as in a search."""
    spark = vectors.sparkSession
    dim = (vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first() or [0])[0]
    if not dim or dim < 1:
        raise ValueError("there are no vectors to store")
    c = centres(vectors, dim, count)
    sent = spark.sparkContext.broadcast(c)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                v, c = scan._matrix(pdf["embedding"]), sent.value
                near = (v @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
                yield pdf.assign(cluster=near.astype(np.int32), far=np.sqrt(((v - c[near]) ** 2).sum(axis=1)))

    kept = vectors.filter(F.size("embedding") == dim).select("case_id", "chunk_ord", "embedding")
    kind = dict(kept.dtypes)["embedding"]
    placed = kept.mapInPandas(place, f"case_id string, chunk_ord bigint, embedding {kind}, cluster int, far double")
    placed.write.partitionBy("cluster").mode("overwrite").parquet(f"{path}/vectors")
    spark.read.parquet(f"{path}/vectors").groupBy("case_id", "cluster").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/balls")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Clustered:
    c = spark.read.parquet(f"{path}/centres").orderBy("cluster").toPandas()  # MOST_CENTRES rows at most
    return Clustered(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/balls"), scan._matrix(c["centre"]))


def _held(index: Clustered, queries: DataFrame) -> tuple[dict, dict]:
    """Per case: query ids and vectors, and bounds (queries x clusters) and sizes of its balls."""
    rows = queries.select("query_id", "case_id", "embedding").toPandas()
    rows = rows[rows["embedding"].map(len) == index.centres.shape[1]]
    cases = queries.sparkSession.createDataFrame([(c,) for c in rows["case_id"].unique()], "case_id string")
    balls = index.balls.join(F.broadcast(cases), "case_id").toPandas()
    held, bounds = {}, {}
    sizes = {case: part for case, part in balls.groupby("case_id")}
    for case, part in rows.groupby("case_id"):
        q = scan._matrix(part["embedding"])
        held[case] = part["query_id"].to_numpy(), q
        bound, n = np.full((len(q), len(index.centres)), -np.inf), np.zeros(len(index.centres), np.int64)
        if case in sizes:
            at = sizes[case]["cluster"].to_numpy()
            bound[:, at] = q @ index.centres[at].T + np.sqrt((q * q).sum(axis=1))[:, None] * sizes[case]["radius"].to_numpy()
            n[at] = sizes[case]["n"].to_numpy()
        bounds[case] = bound, n
    return held, bounds


def _first(bound: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """For each query the clusters of the highest bounds, until they hold ``top`` vectors."""
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    out = np.zeros(bound.shape, bool)
    np.put_along_axis(out, order, before < top, axis=1)
    return out & (bound > -np.inf)


def _scored(index: Clustered, held: dict, wanted: dict, top: int) -> DataFrame:
    """Best rows per query and batch, of the clusters each query wants; others aren't read."""
    needed = sorted({int(k) for mask in wanted.values() for k in np.flatnonzero(mask.any(axis=0))})
    sent = index.vectors.sparkSession.sparkContext.broadcast((held, wanted))

    def run(batches):
        held, wanted = sent.value
        for pdf in batches:
            for (case, cluster), part in pdf.groupby(["case_id", "cluster"]):
                if case in held:
                    own = wanted[case][:, cluster]
                    if own.any():
                        ids, q = held[case]
                        yield from scan._best(ids[own], q[own], case, part["chunk_ord"].to_numpy(), scan._matrix(part["embedding"]), top)

    rows = index.vectors.filter(F.col("cluster").isin(needed)).select("case_id", "chunk_ord", "embedding", "cluster")
    return first_rows(rows.mapInPandas(run, scan.HITS), QUERY, [F.desc("score"), "chunk_ord"], top, rank="rank")


def _open(index: Clustered, query_vectors: DataFrame, top: int) -> tuple[dict, dict, dict]:
    """What the queries are, the clusters that each must read, and the sizes of these."""
    held, bounds = _held(index, query_vectors)
    first = {case: _first(bound, n, top) for case, (bound, n) in bounds.items()}
    sure = _scored(index, held, first, top).filter(F.col("rank") == top).toPandas()  # one row per query
    wanted = {}
    for case, (bound, _) in bounds.items():
        mine = sure[sure["case_id"] == case].set_index("query_id")["score"]
        floor = np.array([mine.get(i, -np.inf) for i in held[case][0]])
        wanted[case] = (bound + ROUNDING >= floor[:, None]) & (bound > -np.inf)
    return held, wanted, {case: n for case, (_, n) in bounds.items()}


def search(index: Clustered, query_vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of :func:`dense.dense` over the stored vectors. A query set over ``dense.QUERY_BYTES`` goes by the scan."""
    top = limit or rules.TOP_K * rules.SEARCH_MULT
    if query_vectors.count() * index.centres.shape[1] * 8 > scan.QUERY_BYTES:
        return scan.dense(index.vectors, query_vectors, top)
    held, wanted, _ = _open(index, query_vectors, top)
    return _scored(index, held, wanted, top)


def share_read(index: Clustered, query_vectors: DataFrame, limit: int | None = None) -> pd.DataFrame:
    """query_id, case_id, n_read, n_all: how many vectors of its case each query is held against."""
    held, wanted, sizes = _open(index, query_vectors, limit or rules.TOP_K * rules.SEARCH_MULT)
    return pd.concat([pd.DataFrame({"query_id": held[c][0], "case_id": c, "n_read": wanted[c] @ sizes[c], "n_all": int(sizes[c].sum())}) for c in held])
