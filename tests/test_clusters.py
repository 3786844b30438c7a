"""Search over clusters gives what a scan gives, and reads less."""

import numpy as np
import pytest

from liasse.operators import clusters, dense


def table(spark, rows):
    return spark.createDataFrame([(c, i, [float(x) for x in v]) for c, i, v in rows], "case_id string, chunk_ord bigint, embedding array<float>")


def test_clusters_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 8)) * 4
    rows = [("ab"[i % 5 == 0], i, heads[i % 12] + rng.normal(size=8) * 0.3) for i in range(1500)]
    rows += [("a", 5000 + i, rows[1][2]) for i in range(5)] + [("a", 9000, np.zeros(8))]
    vectors = table(spark, rows).unionByName(table(spark, [("a", 9999, [1.0, 2.0])]))
    q = [(k, "ab"[k % 2], heads[k % 12] + rng.normal(size=8) * 0.2) for k in range(10)] + [(3, "a", rng.normal(size=8)), (50, "z", heads[0])]
    queries = spark.createDataFrame([(i, c, [float(x) for x in v]) for i, c, v in q], "query_id bigint, case_id string, embedding array<float>")
    index = clusters.build(vectors, str(tmp_path / "v"), 16)
    assert index.vectors.count() == len(rows)
    for limit in (1, 7, 2000):
        want = sorted(map(tuple, dense.dense(vectors, queries, limit).collect()))
        assert sorted(map(tuple, clusters.search(index, queries, limit).collect())) == want
    share = clusters.share_read(index, queries, 7)
    near = share[(share["query_id"] < 10) & (share["case_id"] != "z")]
    assert near["n_read"].sum() < 0.6 * near["n_all"].sum() and (share["n_read"] <= share["n_all"]).all()


def test_no_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        clusters.build(table(spark, []), str(tmp_path / "v"))
