"""What tasks hold at once, and what they leave behind."""

import tracemalloc

import numpy as np

from strandline.llm import common, near_join
from strandline.llm import words as W


def test_sets_of_texts_take_little_memory():
    texts = near_join.pa.array([" ".join(f"w{k}x{i}" for i in range(150)) for k in range(2000)])
    W.forget_powers()
    tracemalloc.start()
    sizes = [len(own) for _, own in near_join.text_sets(texts)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sizes == [147] * 2000
    assert peak < 24e6


def test_scans_leave_neither_broadcasts_nor_powers_in_workers(spark):
    shared = spark.sparkContext.broadcast(np.arange(1000))

    def scan(batches):
        for batch in batches:
            held = len(shared.value) + len(W.word_hashes(np.frombuffer(b"a b", np.uint8), np.array([0, 2]), np.array([1, 3])))
            yield near_join.pa.RecordBatch.from_arrays([near_join.pa.array([held] * batch.num_rows)], names=["held"])

    def left(batches):
        for batch in batches:
            held = len(W._powers) + sum("_value" in vars(x) for x in (shared,))
            yield near_join.pa.RecordBatch.from_arrays([near_join.pa.array([held] * batch.num_rows)], names=["held"])

    for _ in range(2):  # a later task reads the broadcast anew
        rows = spark.range(0, 8, 1, 2).mapInArrow(common.releasing(scan, shared), "held long").collect()
        assert {r.held for r in rows} == {1002}
    assert {r.held for r in spark.range(0, 8, 1, 2).mapInArrow(left, "held long").collect()} == {0}


def test_heaps_are_collected(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    common.shrink_heaps(spark)
    assert sum(b.getCollectionCount() for b in beans()) > before
