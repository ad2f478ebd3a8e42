"""The byte-level network: held-out quality, gradients and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = queries.op2_byte_cnn_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    pos, neg = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(pos) > 20 and len(neg) > 3
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x", 0.5), (3, "x", 0.5), (None, "y" * 3_000_000, 0.5)], "doc_id long, text string, score double")
    none = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    rows = quality.predict(docs, none).collect()
    assert len(rows) == 5 and all(abs(r.score - 0.5) < 1e-3 for r in rows)
    net = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"))
    by = {r.doc_id: r.score for r in quality.predict(docs, net).collect()}
    assert by[1] == by[2]
    assert quality.predict(docs.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        quality.predict(docs.withColumn("score", F.lit("s")), net, text_col="score")


def test_every_byte_counts_and_blocks_dont():
    net = quality.train([b"good words here. " * 9, b"bad!! words!! " * 9] * 20, [1, 0] * 20, epochs=10)
    texts = [b"", b"abc", b"good words here. " * 500 + b"bad!! words!! ", b"good words here. " * 500]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.probabilities(np.frombuffer(b"".join(texts), np.uint8), offs)
    alone = [net.probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    assert together[2] < together[3]


def test_parts_of_a_long_text_pool_as_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    net = quality.train([b"good words here. " * 9, b"bad!! words!! " * 9] * 20, [1, 0] * 20, epochs=3)
    texts = [rng.integers(97, 103, n).astype(np.uint8) for n in (5000, 5001, 4096, 4999)]
    whole = [net.pooled(x, np.array([0, len(x)])) for x in texts]
    monkeypatch.setattr(quality, "PART", 256)
    assert all(np.allclose(net.pooled(x, np.array([0, len(x)])), w, atol=1e-5) for x, w in zip(texts, whole, strict=True))


def test_long_texts_leave_the_sample_full(spark):
    docs = spark.createDataFrame([(k, "y" * 500 if k < 60 else "x") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    seen = []
    quality_train, quality.train = quality.train, lambda texts, labels: seen.append(len(texts))
    try:
        quality.fit(docs, labels, sample=30, longest=100)
    finally:
        quality.train = quality_train
    assert seen == [30]


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network.fresh(3)
    net.out[:] = rng.standard_normal(quality.FILTERS)
    texts, y = [b"abcabcabcabcabc hello", b"another text, longer than one chunk of bytes", b"zz"], np.array([1, 0, 1], np.float32)

    def loss():
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p = net.probabilities(np.frombuffer(b"".join(texts), np.uint8), offs)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality._gradients(net, texts, y)
    for name, at in (("out", (2,)), ("offset", (0,)), ("bias", (4,)), ("window", (0, 5, 1)), ("window", (1, quality.WIDTH, 7)), ("embed", (ord("b"), 2))):
        value = net.parts()[name]
        old, step = value[at], 1e-2
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert abs((up - down) / (2 * step) - grads[name][at]) < 3e-3
