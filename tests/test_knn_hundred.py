"""The k-NN join gives a hundred neighbours of each point."""

import numpy as np

from strandline.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_hundred_neighbours_equal_all_distances(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for r in QUERIES["jn23_knn_top_m"](spark, SF).collect():
        found.setdefault(r.id, {})[r["rank"]] = r.distance
    assert set(found) == set(ids.tolist())
    for k in range(0, len(ids), 25):
        want = np.sort(((v - v[k]) ** 2).sum(axis=1))[:100]
        assert sorted(found[ids[k]]) == list(range(1, 101))
        assert np.allclose([found[ids[k]][n] for n in range(1, 101)], want, atol=2e-6)
