"""Connected components by alternating large-star and small-star steps, each one exchange and one streamed pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import release, remove_path, stored

#: Edges that a task holds before it sends their forest on, and of which it gives the memory back; that takes longer than a small task.
EDGES_HELD, RELEASED = 500_000, 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), each beside the least node that these edges join it with, without those nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, further := root[root]):
            root = further
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: Goes with the edges of a round that began with something else than stars.
_UNDONE = pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's greater neighbours beside the least of its neighbours and itself; and a row of nulls from each task that
    finds a node with a lesser neighbour and another one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = other = least = None  # those of the row before
        undone = False
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (c.to_numpy() for c in batch.columns)
            fresh, new = np.ones(len(u), bool), np.ones(len(u), bool)
            fresh[1:] = u[1:] != u[:-1]
            new[1:] = fresh[1:] | (v[1:] != v[:-1])
            fresh[0] = u[0] != node
            new[0] = fresh[0] or v[0] != other
            own = np.minimum(u, v)  # right where a node begins, as its neighbours are sorted
            if not fresh[0]:
                own[0] = least
            own = own[np.maximum.accumulate(np.where(fresh, np.arange(len(u)), 0))]
            undone = undone or bool((new & ~fresh & (own < u)).any())
            up = np.flatnonzero(new & (v > u))
            node, other, least = u[-1], v[-1], own[-1]
            if len(up):
                yield _batch(v[up], own[up])
        if undone:
            yield _UNDONE

    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    return both.repartition("u").sortWithinPartitions("u", "v").mapInArrow(scan, "a long, b long")


def _small_star(edges: DataFrame) -> DataFrame:
    """The edges, dealt by their greater ends, as forests of what hangs together within a task; a row of nulls if there is one."""
    most = EDGES_HELD

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held, large, undone = 0, False, False
        for batch in batches:
            if batch.column(0).null_count:
                undone, batch = True, batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n_held += batch.num_rows
            large = large or n_held >= RELEASED
            if n_held >= most:
                last = held[-1][0][-1]
                a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                own = a == last  # what follows may have more edges of this node
                yield _batch(a[~own], b[~own])
                held, n_held = [(a[own], b[own])], 1
        if n_held:
            yield _batch(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))
        if undone:
            yield _UNDONE
        if large:
            held.clear()
            release()

    return edges.repartition("a").sortWithinPartitions("a").mapInArrow(scan, "a long, b long")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges``, a table of pairs (a, b) of longs; root is the component's least node.

    Each round is written to the shared folder, which cuts the lineage, and the round before it is deleted; the rounds
    end once one has begun with stars. A step shuffles its edges once and streams over those of a node, so that a hub is
    many rows in one task at worst, never a group in memory, and a round has few tasks that the driver must keep account of.
    Both steps only lower the ends of edges, until there is nothing to lower. Loops and repeated edges are allowed, rows
    with a null end are dropped; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    down = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = stored(_small_star(down), label)
    while True:
        then, old = now, path
        now, path = stored(_small_star(_large_star(then.filter("a is not null"))), label)
        remove_path(spark, old)
        if now.filter("a is null").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
