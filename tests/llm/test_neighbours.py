"""The hash-prefix forest against brute force."""

import math

import numpy as np
import pytest

from strandline.llm import neighbours, queries

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for qid, q in {i: v for i, v in use if i in asked}.items():
        scored = sorted((-float(q @ v), i) for i, v in use if i != qid and len(v) == len(q))[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def recall(rows, got, k=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found, hits, total = {}, 0, 0
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert math.isclose(r.score, float(v[ids == r.query_id][0] @ v[ids == r.vec_id][0]), abs_tol=1e-12)
    for q in ids[ids % 20 == 0].tolist():
        scores = v @ v[ids == q][0]
        scores[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]].tolist())
        hits, total = hits + len(best & found[q]), total + len(best)
        assert len(found[q]) == min(k, len(ids) - 1)
    return hits / total


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_all_queries_with_production_settings(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(rows, queries.op8_hash_prefix_forest(spark, folder).collect()) >= 0.9


def test_recall_over_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((6000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    assert recall(rows, neighbours.nearest(df, asked, index_block=2000).collect()) >= 0.9
    assert recall(rows, neighbours.exact(df, asked, index_block=2000).collect()) == 1


def test_ties_odd_vectors_and_small_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-1, 2, 3).astype(float).tolist()) for k in range(300)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 0.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (305, [1.0, 2.0]), (306, [2.0, 1.0]), (None, [1.0, 1.0, 1.0]), (307, [])]
    rows += [(k, [1.0, 1.0, 1.0]) for k in range(400, 900)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    for block in (50, 10_000):
        got = neighbours.exact(df, df.filter("vec_id % 5 = 0"), k=7, index_block=block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        same(sorted(tuple(r) for r in got.collect()), brute(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 7))
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0
    one = df.filter("vec_id = 305")
    assert neighbours.nearest(one, one).count() == 0


def test_prefix_ranges():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((500, 16))
    forest = neighbours.Forest(vectors, trees=4, bits=10)
    names = forest.names(vectors)
    assert (np.sort(names, axis=0) == forest.sorted).all()
    assert {int(x).bit_length() for x in neighbours.Forest(vectors, trees=2).names(vectors).reshape(-1)} >= {63, 64}
    for q, found in zip(range(20), forest.candidates(vectors[:20], 40), strict=True):
        assert q in found and len(found) >= 40
        depth = min(max(10 - int(x ^ y).bit_length() for x, y in zip(names[q], names[c], strict=True)) for c in found)
        shared = {c for c in range(500) if max(10 - int(x ^ y).bit_length() for x, y in zip(names[q], names[c], strict=True)) >= depth}
        assert set(found.tolist()) == shared
