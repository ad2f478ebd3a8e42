"""Classifiers: shapes, determinism, gradients and the effect of their parameters."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from strandline.operators import evaluation as E
from strandline.operators import models as M


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.4).astype(float)
    rows = [(k, float(y[k]), int(k % 30), x[k].tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "resume_id long, label double, k int, x array<double>")
    return df.select("resume_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("date"), F.col("k").alias("day"), "label", array_to_vector("x").alias("features")).persist()


def accuracy(model, samples):
    rows = model(samples).select("label", "prediction").collect()
    assert len(rows) == 400
    return np.mean([r.label == r.prediction for r in rows])


@pytest.mark.parametrize("fit", [M.decision_tree, M.indexed_tree, lambda d: M.random_forest(d, trees=5, depth=4), lambda d: M.boosted_trees(d, iterations=3, depth=3), M.linear_svm, M.logistic, M.Descent(step=2.0, iterations=30).model])
def test_models_learn(samples, fit):
    assert accuracy(fit(samples), samples) > 0.7


def test_hybrids_learn(samples):
    assert accuracy(M.hybrid(samples, M.logistic, trees=4, depth=4), samples) > 0.85
    assert accuracy(M.hybrid(samples, M.logistic, boosted=True, trees=3, depth=3), samples) > 0.85
    assert accuracy(M.hybrid(samples, M.Descent(step=2.0).model, trees=4, depth=4, keep=["features"], columns=[0, 1]), samples) > 0.7


def test_descent_equals_numpy(samples):
    rows = samples.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    for gamma in (0.0, 0.2):
        w = np.zeros(4)
        for t in range(1, 6):
            p = 1 / (1 + np.exp(-x @ w))
            g = (p - np.where(y > 0.5, 1, gamma)) @ x / len(y)
            w = w * (1 - 0.1 / np.sqrt(t) * 0.01) - 0.1 / np.sqrt(t) * g
        got, losses = M.Descent(iterations=5, gamma=gamma, tolerance=0).fit(samples)
        assert np.allclose(got, w)
        assert losses == sorted(losses, reverse=True)


def test_sparse_leaves_zeros_out(spark):
    rows = [(Vectors.dense([0.0, 2.0, 0.0, -1.0]),), (Vectors.dense([0.0]),), (Vectors.sparse(4, [1, 2], [3.0, 0.0]),), (None,)]
    got = [r.x and (r.x["indices"], r.x["values"]) for r in spark.createDataFrame(rows, ["features"]).select(M.sparse().alias("x")).collect()]
    assert got == [([1, 3], [2.0, -1.0]), ([], []), ([1, 2], [3.0, 0.0]), None]


def test_gamma_raises_recall(samples):
    found = [M.Descent(step=1.0, iterations=20, gamma=g).model(samples)(samples).filter("prediction = 1 and label = 1").count() for g in (-0.2, 0.0, 0.3)]
    assert found[0] <= found[1] <= found[2]


def test_time_weights_and_neighbours(samples):
    weighted = E.time_weights(samples)
    assert weighted.agg(F.max("weight")).first()[0] == 1.0
    plain, _ = M.Descent().fit(samples)
    timed, _ = M.Descent().fit(weighted, "weight")
    pulled, _ = M.Descent(match=0.1).fit(samples.withColumn("neighbours", F.array(F.lit([1.0, 0.0, 0.0, 0.0]), F.lit(None).cast("array<double>"))))
    assert not np.allclose(plain, timed) and not np.allclose(plain, pulled)
    empty, _ = M.Descent().fit(samples.limit(0))
    assert len(empty) == 0


def test_sweep(samples):
    rows = M.sweep(samples, samples, lambda d, depth: M.decision_tree(d, int(depth)), [1, 3], lambda p: p.agg(F.sum("prediction").alias("n"))).collect()
    assert [r.parameter for r in rows] == [1.0, 3.0]


def test_several_gammas_in_one_pass(samples):
    gammas = [0.0, 0.2, 0.3]
    every = M.Descent(step=1.0).fit_each(samples, gammas)
    for gamma, (weights, losses) in zip(gammas, every, strict=True):
        alone, own = M.Descent(step=1.0, gamma=gamma).fit(samples)
        assert np.allclose(weights, alone) and np.allclose(losses, own)
