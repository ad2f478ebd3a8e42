"""Pairs of resumes and positions, their weights, path counts, factors and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import flag_weight, normalized


def pairs(actions: DataFrame, registrations: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Distinct clicks ('C') and deliveries ('D') as resumeid, positionid, time and flag."""
    clicks = actions.join(registrations, "userid").select("resumeid", F.col("infoid").alias("positionid"), F.col("clicktime").alias("time")).distinct()
    sent = deliveries.select("resumeid", "positionid", F.col("deliverytime").alias("time")).distinct()
    both = clicks.withColumn("flag", F.lit("C")).unionByName(sent.withColumn("flag", F.lit("D")))
    return both.withColumn("time", F.expr("try_cast(time as bigint)")).filter("time is not null and resumeid is not null and positionid is not null")


def index_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """Each distinct id with a dense index from 0 in the order of ids.

    Ids are counted by range partition first, so that no task numbers them all.
    """
    ids = rows.select(id_col).distinct().repartitionByRange(id_col).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(id_col)
    numbered = ids.withColumn("k", F.row_number().over(within))
    sizes = numbered.groupBy("part").agg(F.max("k").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before), "part").select(id_col, (F.col("before") + F.col("k") - 1).cast("bigint").alias("index"))


def pair_weights(all_pairs: DataFrame) -> DataFrame:
    return all_pairs.groupBy("resumeid", "positionid").agg(F.sum(flag_weight(F.col("flag"))).alias("weight"))


def path_counts(weights: DataFrame, squarings: int = 3) -> DataFrame:
    """Natural logarithms of the weighted numbers of paths of 2**squarings steps that end in each node of the two-sided graph.

    Column sums of a matrix power need no matrix product: a vector is passed along the edges once for each step.
    """
    edges = weights.select(F.concat(F.lit("r"), F.col("resumeid").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("positionid").cast("string")).alias("b"), F.col("weight").cast("double").alias("w"))
    edges = edges.union(edges.select("b", "a", "w"))
    score = edges.select(F.col("a").alias("node")).distinct().withColumn("v", F.lit(1.0))
    for _ in range(2**squarings):
        score = edges.join(score, edges.a == score.node).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return score.select("node", F.log("v").alias("log_paths"))


def latent_factors(weights: DataFrame, rank: int = 50, iterations: int = 10, reg: float = 0.01, seed: int = 7) -> DataFrame:
    """resumeid and its factors by alternating least squares on the pair weights."""
    users = StringIndexer(inputCol="rid", outputCol="u", stringOrderType="alphabetAsc")
    items = StringIndexer(inputCol="pid", outputCol="i", stringOrderType="alphabetAsc")
    text = weights.select(F.col("resumeid").cast("string").alias("rid"), F.col("positionid").cast("string").alias("pid"), "weight")
    user_index, item_index = users.fit(text), items.fit(text)
    coded = item_index.transform(user_index.transform(text)).select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.col("weight").cast("float").alias("weight"), "rid")
    model = ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="u", itemCol="i", ratingCol="weight", seed=seed).fit(coded)
    names = coded.select(F.col("u").alias("id"), "rid").distinct()
    return model.userFactors.join(names, "id").select(F.col("rid").cast("bigint").alias("resumeid"), F.col("features").cast("array<double>").alias("features"))


def _nearest(points: DataFrame, k: int, block: int, itself: bool, digits: int | None) -> DataFrame:
    """For points (g, id, v) the ``k`` nearest of the same group g by squared distance, ties to the smaller id.

    Blocks of a group meet in tasks, two and two; each keeps ``k`` of a block for each point before these are ranked. A
    product of matrices picks them, and their distances are then worked out one by one.
    """
    blocks = points.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = points.join(blocks, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = dealt.select("g", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "id", "v")
    there = dealt.select("g", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            ids, v, asks = (np.concatenate(x) for x in zip(*held, strict=True))
            q, qid, p, pid = v[asks], ids[asks], v[~asks], ids[~asks]
            squares, out = (p * p).sum(axis=1), []
            for at in range(0, len(q), 256):
                near = squares - 2 * (q[at : at + 256] @ p.T)  # less each query's own square
                for x, name, rough in zip(q[at : at + 256], qid[at : at + 256].tolist(), near, strict=True):
                    take = min(len(rough), k + 1) - 1
                    cut = np.partition(rough, take)[take] if len(rough) else 0.0
                    some = np.flatnonzero(rough <= cut + 1e-7 + 1e-9 * (abs(cut) + float(x @ x)))
                    some = some if itself else some[pid[some] != name]
                    dist = ((p[some] - x) ** 2).sum(axis=1)
                    dist = dist if digits is None else np.round(dist, digits)
                    best = np.lexsort((pid[some], dist))[:k]
                    out.append((np.full(len(best), name), pid[some][best], dist[best]))
            a, b, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key[0])).cast(pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d)], names=["g", "id", "neighbour", "distance"])

        key, held = None, []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(names[a].tolist()) != key:
                    if held:
                        yield answer()
                    key, held = tuple(names[a].tolist()), []
                part = batch.slice(a, b - a)
                held.append((part.column(4).to_numpy().copy(), part.column(5).flatten().to_numpy().reshape(b - a, -1).copy(), part.column(3).to_numpy(zero_copy_only=False)))
        if held:
            yield answer()

    met = asked.union(there).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = met.mapInArrow(search, "g int, id bigint, neighbour bigint, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("g", "id").orderBy("distance", "neighbour")).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def nearest(points: DataFrame, k: int, id_col: str = "id", vector_col: str = "v", block: int = 2048) -> DataFrame:
    """The ``k`` nearest points of every point by squared distance of the normalised vectors, itself included."""
    v = normalized(F.col(vector_col).cast("array<double>"))
    found = _nearest(points.select(F.lit(0).alias("g"), F.col(id_col).cast("bigint").alias("id"), v.alias("v")), k, block, True, None)
    return found.select("id", "rank", "neighbour", "distance")


def nearest_in_day(rows: DataFrame, columns: list[str], k: int = 3, block: int = 2048) -> DataFrame:
    """The ``k`` resumes nearest to each resume on the same day by squared distance, itself excluded."""
    points = rows.select(F.unix_date("date").alias("g"), F.col("resumeid").cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    # equal vectors are looked for once, under their least id; k + 1 of them and of the ids of each hold what any one needs
    alike = Window.partitionBy("g", "v").orderBy("id")
    points = points.select("g", "id", "v", F.first("id").over(alike).alias("least"), F.row_number().over(alike).alias("n")).persist()
    found = _nearest(points.filter("n = 1").select("g", "id", "v"), k + 1, block, True, 8).select("g", F.col("id").alias("least"), "neighbour", "distance")
    firsts = points.filter(F.col("n") <= k + 1).select("g", F.col("least").alias("neighbour"), "id")
    near = found.join(firsts, ["g", "neighbour"]).groupBy("g", "least").agg(F.sort_array(F.collect_list(F.struct("distance", F.col("id").alias("neighbour")))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    ranked = points.select("g", "least", "id").join(near, ["g", "least"]).select("g", "id", F.posexplode(others).alias("k", "one"))
    return ranked.select(F.col("id").alias("resumeid"), F.date_from_unix_date("g").alias("date"), "one.neighbour", "one.distance", (F.col("k") + 1).cast("bigint").alias("rank"))


def neighbour_features(neighbours: DataFrame, features: DataFrame, columns: list[str], inner: bool = False) -> DataFrame:
    """The neighbours' features on the same day, side by side as n1_, n2_ and n3_; missing ones are null, or go if ``inner``."""
    values = features.select(F.col("resume_id").alias("neighbour"), "date", *columns)
    found = neighbours.join(values, ["neighbour", "date"], "left")
    pick = [F.max(F.when(F.col("rank") == n, F.col(c))).alias(f"n{n}_{c}") for n in (1, 2, 3) for c in columns]
    out = found.groupBy("resumeid", "date").agg(*pick)
    return out.dropna() if inner else out
