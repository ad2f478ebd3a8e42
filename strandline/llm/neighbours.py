"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree names a vector by a long string of bits, the signs of random projections, and keeps the names sorted. A query
descends in each tree to the names that share its longest prefixes; then it ascends in all trees at once, one bit at a
time, and takes in what shares the shorter prefixes, until it has enough candidates. Those are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import releasing

#: Trees, and bits of a name.
TREES, BITS = 96, 64
#: A query ascends until it has met FACTOR * n**POWER distinct vectors of n: an ever smaller share of a larger table.
FACTOR, POWER = 6.0, 0.7
#: Vectors of an index block, and queries that are looked up in it together.
INDEX_BLOCK, QUERIES = 8192, 1024
SEED = 77


class Forest:
    """Sorted names of distinct vectors, one array for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits, self.vectors = trees, bits, vectors
        self.centre = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], bits)).astype(np.float32)
        names = self.names(vectors)
        self.order = np.asfortranarray(np.argsort(names, axis=0, kind="stable").astype(np.int32))
        self.sorted = np.asfortranarray(np.take_along_axis(names, self.order, axis=0))  # a tree's names lie together

    def names(self, vectors: np.ndarray) -> np.ndarray:
        """A string of bits, the first one highest, for each vector and tree."""
        shifted, out = (vectors - self.centre).astype(np.float32), np.zeros((len(vectors), self.trees), np.uint64)
        for t in range(self.trees):
            packed = np.zeros((len(vectors), 8), np.uint8)
            signs = np.packbits(shifted @ self.planes[t] > 0, axis=1)
            packed[:, : signs.shape[1]] = signs
            out[:, t] = packed.view(">u8")[:, 0] >> np.uint64(64 - self.bits)
        return out

    def _ranges(self, names: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """For each depth, query and tree the range of sorted names that share so many first bits.

        Depths reach down to the longest prefixes that count: the first at which no query meets ``enough`` names any more.
        """
        low, high = [np.zeros(names.shape, np.int32)], [np.full(names.shape, len(self.vectors), np.int32)]
        for depth in range(1, self.bits + 1):
            rest = np.uint64((1 << (self.bits - depth)) - 1)
            first, last = np.empty(names.shape, np.int32), np.empty(names.shape, np.int32)
            for t in range(self.trees):
                first[:, t] = np.searchsorted(self.sorted[:, t], names[:, t] & ~rest, side="left")
                last[:, t] = np.searchsorted(self.sorted[:, t], names[:, t] | rest, side="right")
            if ((last - first).sum(axis=1) < enough).all():
                break
            low.append(first)
            high.append(last)
        return np.stack(low), np.stack(high)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, places of candidates: all trees ascend together until ``enough`` distinct ones are met."""
        enough = min(enough, len(self.vectors))
        low, high = self._ranges(self.names(queries), enough)
        met = (high - low).sum(axis=2)
        seen = np.zeros(len(self.vectors), bool)
        for q in range(len(queries)):
            # a vector may be met in several trees, so the distinct ones can be too few and the ascent goes on
            depth = int(np.flatnonzero(met[:, q] >= enough)[-1])
            while True:
                for t in range(self.trees):
                    seen[self.order[low[depth, q, t] : high[depth, q, t], t]] = True
                found = np.flatnonzero(seen)
                if len(found) >= enough or depth == 0:
                    break
                depth -= 1
            seen[found] = False
            yield found


class Block:
    """A block of the index: its distinct vectors in a forest, and the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, bits: int, seed: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids = ids[by_id]
        self.distinct, place = np.unique(vectors[by_id], axis=0, return_inverse=True)
        place = place.reshape(-1)
        self.members = np.argsort(place, kind="stable")  # by vector, then by id
        self.bounds = np.searchsorted(place[self.members], np.arange(len(self.distinct) + 1))
        self.forest = Forest(self.distinct, trees, bits, seed)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` candidates for each query, as (query id, id, score)."""
        out, bounds = [], self.bounds
        enough = max(k + 1, math.ceil(share * len(self.distinct)))
        for qid, vector, found in zip(query_ids.tolist(), queries, self.forest.candidates(queries, enough), strict=True):
            scores = self.distinct[found] @ vector
            if len(scores) > k + 1:  # one more than asked for: the query itself may be among them
                cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                found = found[scores >= cut - 1e-9 * (1 + abs(cut))]
            scores = (self.distinct[found] * vector).sum(axis=1)  # row by row, so that equal vectors score alike in every block
            near = np.concatenate([self.members[bounds[x] : min(bounds[x + 1], bounds[x] + k + 1)] for x in found])
            score = np.repeat(scores, [min(bounds[x + 1] - bounds[x], k + 1) for x in found])
            own = self.ids[near] != qid
            near, score = near[own], score[own]
            best = np.lexsort((self.ids[near], -score))[:k]
            out.append((np.full(len(best), qid), self.ids[near[best]], score[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: an id, and a vector of finite components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, factor: float = FACTOR, power: float = POWER, index_block: int = INDEX_BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows of ``df`` nearest to each row of ``queries``.

    Nearness is the largest inner product, in double precision; a row isn't its own neighbour (by id); ties go to the
    smaller id; fewer rows than ``k`` give all. Vectors that are null, zero or hold null or non-finite components take
    no part, nor do rows with a null id; vectors of other lengths than the query's are not compared with it. Equal
    vectors are searched once and each of their rows can be returned. Rows that repeat an id repeat in the result as
    neighbours but are one query. Empty tables give an empty result; other columns are not carried.

    A query meets at least factor * n**power of the n vectors, in equal shares of all blocks, and ``k`` + 1 of each block; one rule for tables
    of every size, under which small ones are met almost whole. The index is dealt by a hash of the id into blocks of about
    ``index_block`` vectors. Each block's forest is built once, in one task, through which all queries then stream; a query
    keeps ``k`` rows of each block at most, before these are ranked. Queries are copied to every block.
    """
    if not 1 <= bits <= 64:
        raise ValueError("a name has 1 to 64 bits")
    index, asked = _usable(df, id_col, vector_col), _usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    size = index.count()
    blocks, share = max(1, -(-size // index_block)), min(1.0, factor * size ** (power - 1)) if size else 1.0
    own = F.pmod(F.xxhash64("vec_id", F.lit(blocks)), F.lit(blocks)).cast("int")
    rows = index.withColumn("block", own).withColumn("query", F.lit(False))
    asks = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(True))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held = None, None, ([], [])
        for batch in batches:
            names = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                dim, number, asking = (int(x) for x in names[a])
                if (dim, number) != key:
                    key, block, held = (dim, number), None, ([], [])
                part = batch.slice(a, b - a)
                ids, vectors = part.column(2).to_numpy(), part.column(3).flatten().to_numpy().reshape(b - a, dim)
                if not asking:  # a block's vectors come before its queries
                    held[0].append(ids.copy())
                    held[1].append(vectors.copy())
                elif held[0] or block:
                    if block is None:
                        block, held = Block(np.concatenate(held[0]), np.concatenate(held[1]), trees, bits, seed), ([], [])
                    for at in range(0, len(ids), QUERIES):
                        q, i, s = block.top(ids[at : at + QUERIES], vectors[at : at + QUERIES], k, share)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    columns = ["dim", "block", "vec_id", "v", "query"]
    both = rows.select(columns).union(asks.select(columns))
    found = both.repartition("dim", "block").sortWithinPartitions("dim", "block", "query").mapInArrow(releasing(search), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(df: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """The same by scoring every row; to measure recall with."""
    return nearest(df, queries, k, factor=1.0, power=1.0, **options)
