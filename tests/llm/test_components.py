"""Components against union-find, and how many jobs and tasks the driver must keep account of."""

import random

import numpy as np
import pytest

from strandline.llm import components, spans


@pytest.fixture
def parts(spark):
    """Thirty-two partitions in every exchange."""
    own = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield 32
    for k, v in before.items():
        spark.conf.set(k, v)


def counted(spark, run):
    """What ``run`` gives, and the numbers of jobs and tasks that it took."""
    sc = spark.sparkContext._jsc.sc()
    at = lambda: (sc.dagScheduler().nextJobId(), sc.taskScheduler().nextTaskId())
    before = at()
    out = run()
    return out, *(b - a for a, b in zip(before, at(), strict=True))


def least(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_graphs_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_HELD", 7)
    rng = random.Random(5)
    name = lambda: rng.choice([-1, 1]) * rng.randrange(1 << 62)
    for nodes, n in ((300, 260), (60, 400)):
        names = [name() for _ in range(nodes)]
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(n)]
        chain = sorted(name() for _ in range(200))
        hub, leaves = name(), [name() for _ in range(100)]
        edges += [*zip(chain, chain[1:], strict=False), *((hub, x) for x in leaves), *edges[:20]]
        rng.shuffle(edges)
        rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.root for r in rows} == least(edges)


def test_null_ends(spark):
    rows = components.connected_components(spark.createDataFrame([(1, None), (None, 2), (None, None), (3, 4)], "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {3: 3, 4: 3}


def test_forest():
    a, b = components.forest(np.array([9, 4, 7]), np.array([4, -2, 5]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {9: -2, 4: -2, 7: 5}


def test_tasks_of_a_round(spark, parts):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 400, 2)], "a long, b long")
    found, _, tasks = counted(spark, lambda: components.connected_components(edges).collect())
    assert len(found) == 400
    assert tasks < 6 * parts, "one exchange at first, two for the one round and one for the roots"


def test_shared_anchors_in_few_jobs(spark, parts):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, "x " + text), (3, "y")], "doc_id long, text string")
    found, jobs, _ = counted(spark, lambda: spans.repeated_spans(df).collect())
    assert {(r.doc_id, r.n_words, r.removed) for r in found} == {(1, 60, False), (2, 60, True)}
    assert jobs < parts, "not one for each partition"
