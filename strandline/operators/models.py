"""Classifiers: linear, trees, and leaves of trees that feed a logistic model with its own gradients.

Samples have ids, date, label and a vector column ``features``; fitted models are functions of samples that return
them with ``score`` and ``prediction``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler, VectorIndexer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.shared import shared_folder

SEED = 32793
#: Rows that a task of training takes before there are more tasks than cores.
TASK_ROWS = 200_000
Model = Callable[[DataFrame], DataFrame]


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def stored(rows: DataFrame) -> DataFrame:
    """``rows``, written to the shared folder and read from there.

    The driver holds a plan and its description for each query and each change of it, and what is persisted stands in them with all
    that is beneath. Where rows are met several times on each of several steps, that is a power of the steps; from files it is none.
    """
    path = shared_folder(rows.sparkSession, "samples")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows``, stored and kept from there, in no more partitions than there are cores, or one for TASK_ROWS of them where that is
    more.

    Each level of a tree is a job of its own. Without a plan beneath the rows its tasks are small and no stage is gone through in vain.
    """
    kept = stored(rows)
    least = -(-kept.count() // TASK_ROWS)
    dealt = kept.repartition(least) if kept.rdd.getNumPartitions() < least else kept.coalesce(max(least, rows.sparkSession.sparkContext.defaultParallelism))
    return dealt.persist()


def _scored(fitted, threshold: float | None = None) -> Model:
    def predict(samples: DataFrame) -> DataFrame:
        out = fitted.transform(samples)
        if "probability" in out.columns:
            out = out.withColumn("score", vector_to_array("probability")[1])
        else:
            out = out.withColumn("score", vector_to_array("rawPrediction")[1])
        prediction = F.col("prediction") if threshold is None else (F.col("score") >= threshold)
        return out.withColumn("prediction", prediction.cast("int")).select(*samples.columns, "score", "prediction")

    return predict


def decision_tree(train: DataFrame, depth: int = 8, bins: int = 64) -> Model:
    return _scored(DecisionTreeClassifier(maxDepth=depth, maxBins=bins, impurity="gini", seed=SEED).fit(train))


def indexed_tree(train: DataFrame, depth: int = 10) -> Model:
    """A tree over indexed labels and features, its predictions turned back into labels."""
    labels = StringIndexer(inputCol="label", outputCol="indexed_label", stringOrderType="alphabetAsc").fit(train)
    inputs = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=4, handleInvalid="keep").fit(train)
    tree = DecisionTreeClassifier(labelCol="indexed_label", featuresCol="indexed", maxDepth=depth, seed=SEED)
    back = IndexToString(inputCol="prediction", outputCol="text", labels=labels.labels)
    fitted = Pipeline(stages=[labels, inputs, tree, back]).fit(train)

    def predict(samples: DataFrame) -> DataFrame:
        out = fitted.transform(samples).withColumn("score", vector_to_array("probability")[1])
        return out.withColumn("prediction", F.col("text").cast("double").cast("int")).select(*samples.columns, "score", "prediction")

    return predict


def random_forest(train: DataFrame, trees: int = 50, depth: int = 10, bins: int = 64) -> Model:
    return _scored(RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=bins, cacheNodeIds=depth > 10, seed=SEED).fit(train))


def boosted_trees(train: DataFrame, iterations: int = 50, depth: int = 6) -> Model:
    return _scored(GBTClassifier(maxIter=iterations, maxDepth=depth, seed=SEED).fit(train))


def linear_svm(train: DataFrame, iterations: int = 20) -> Model:
    return _scored(LinearSVC(maxIter=iterations, regParam=0.01).fit(train))


def logistic(train: DataFrame, iterations: int = 10, weight: str | None = None, threshold: float = 0.5) -> Model:
    options = {"weightCol": weight} if weight else {}
    return _scored(LogisticRegression(maxIter=iterations, threshold=threshold, **options).fit(train))


# own gradients
def sparse(column: str = "features") -> Column:
    """The entries of a vector column as a structure of indices and values; of a dense vector, those that aren't 0."""
    v = F.unwrap_udt(column)
    size = F.size(v["values"])
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    own = v["type"] == 0
    indices = F.when(own, v["indices"]).otherwise(F.filter(every, lambda k: F.get(v["values"], k) != 0))
    values = F.when(own, v["values"]).otherwise(F.filter(v["values"], lambda x: x != 0))
    return F.when(F.col(column).isNotNull(), F.struct(indices.alias("indices"), values.alias("values")))


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists one after the other, and how many each has."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)


@dataclass(frozen=True)
class Descent:
    """Full-batch gradient descent on the logistic loss, with an L2 penalty and steps that shrink with their number's root.

    ``gamma`` is the label that negatives are pulled to: the larger, the more are found positive. ``match`` weighs the
    pull towards the neighbours' features (column ``neighbours``, an array of dense arrays or of :func:`sparse` entries, null
    where there is none). Vectors stay sparse throughout.
    """

    step: float = 0.1
    iterations: int = 10
    penalty: float = 0.01
    tolerance: float = 1e-4
    gamma: float = 0.0
    match: float = 0.0

    def fit(self, train: DataFrame, weight: str | None = None) -> tuple[np.ndarray, list[float]]:
        """Weights and the loss at each iteration.

        Each task sums its gradient; sums of some tasks are added up in others, so that the driver gets about as many as the
        root of the number of tasks.
        """
        weights, losses = self.fit_each(train, [self.gamma], weight)[0]
        return weights, losses

    def fit_each(self, train: DataFrame, gammas: list[float], weight: str | None = None) -> list[tuple[np.ndarray, list[float]]]:
        """What :meth:`fit` gives for each of several values of gamma; each step of all of them is one pass over the samples."""
        v = sparse()
        columns = [v["indices"].alias("k"), v["values"].alias("x"), F.col("label").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]
        if self.match:
            dense = not train.schema["neighbours"].dataType.simpleString().startswith("array<struct")
            entries = lambda n: F.when(n.isNotNull(), F.struct(F.transform(n, lambda _, i: i).alias("indices"), n.alias("values")))
            columns.append(F.transform("neighbours", entries).alias("near") if dense else F.col("neighbours").alias("near"))
        width = F.max(F.coalesce(F.unwrap_udt("features")["size"], F.size(F.unwrap_udt("features")["values"])))
        width = train.select(width.alias("n")).first().n or 0
        data = train.select(*columns).persist()
        groups = max(1, math.isqrt(data.rdd.getNumPartitions()))
        found = [(np.zeros(width), []) for _ in gammas]
        going = list(range(len(gammas)))
        for t in range(1, self.iterations + 1):
            partial = data.mapInArrow(self._partial([(k, gammas[k], found[k][0]) for k in going]), _SUMS)
            rows = (partial.repartition(groups).mapInArrow(_added, _SUMS) if groups > 2 else partial).collect()
            for k in list(going):
                own = [r for r in rows if r.which == k]
                n = sum(r.n for r in own)
                if not n:
                    going.remove(k)
                    continue
                weights, losses = found[k]
                gradient = sum(np.array(r.gradient) for r in own) / n
                losses.append(sum(r.loss for r in own) / n + 0.5 * self.penalty * float(weights @ weights))
                rate = self.step / np.sqrt(t)
                fresh = weights * (1 - rate * self.penalty) - rate * gradient
                found[k] = fresh, losses
                if np.linalg.norm(fresh - weights) < self.tolerance * max(1.0, np.linalg.norm(fresh)):
                    going.remove(k)
            if not going:
                break
        data.unpersist()
        return found

    def _partial(self, models: list[tuple[int, float, np.ndarray]]):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width, n = len(models[0][2]), 0
            loss, total = [0.0] * len(models), np.zeros((len(models), width))
            for batch in batches:
                rows = batch.num_rows
                if not rows:
                    continue
                (k, sizes), (x, _) = _entries(batch.column(0)), _entries(batch.column(1))
                y, w = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                own = np.repeat(np.arange(rows), sizes)
                n += rows
                if self.match:
                    near, counts = batch.column(4).flatten(), batch.column(4).value_lengths().fill_null(0).to_numpy()
                    there = near.is_valid().to_numpy(zero_copy_only=False)
                    of, near = np.repeat(np.arange(rows), counts)[there], near.filter(pa.array(there))
                    (nk, lengths), (nx, _) = _entries(near.field(0)), _entries(near.field(1))
                for m, (_, gamma, weights) in enumerate(models):
                    dots = np.bincount(own, weights=x * weights[k], minlength=rows)
                    margin = -dots
                    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
                    target = np.where(y > 0.5, 1.0, gamma)
                    factor = w * (p - target)
                    loss[m] += float((w * (np.logaddexp(0, margin) - (1 - target) * margin)).sum())
                    if self.match:
                        pull = np.bincount(np.repeat(np.arange(len(of)), lengths), weights=nx * weights[nk], minlength=len(of)) - dots[of]
                        loss[m] += self.match * float(pull @ pull)
                        total[m] += np.bincount(nk, weights=np.repeat(2 * self.match * pull, lengths) * nx, minlength=width)
                        factor = factor - np.bincount(of, weights=2 * self.match * pull, minlength=rows)
                    total[m] += np.bincount(k, weights=factor[own] * x, minlength=width)
            for m, (number, _, _) in enumerate(models):
                yield _sums(number, loss[m], float(n), total[m])

        return scan

    def model(self, train: DataFrame, weight: str | None = None, threshold: float = 0.5) -> Model:
        return self.scorer(self.fit(train, weight)[0], threshold)

    @staticmethod
    def scorer(weights: np.ndarray, threshold: float = 0.5) -> Model:
        # a list in one text is folded to a constant, where as many literals would swell the plan
        table = F.expr(f"cast(split('{','.join(repr(float(w)) for w in weights)}', ',') as array<double>)") if len(weights) else F.array().cast("array<double>")
        own = sparse()
        products = F.zip_with(own["indices"], own["values"], lambda k, x: F.coalesce(F.get(table, k), F.lit(0.0)) * x)
        score = 1 / (1 + F.exp(-F.aggregate(products, F.lit(0.0), lambda s, x: s + x)))
        return lambda samples: samples.withColumn("score", score).withColumn("prediction", (F.col("score") > threshold).cast("int"))


_SUMS = "which int, loss double, n double, gradient array<double>"


def _sums(which: int, loss: float, n: float, gradient: np.ndarray) -> pa.RecordBatch:
    whole = pa.ListArray.from_arrays(pa.array([0, len(gradient)], pa.int32()), pa.array(gradient))
    return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([loss]), pa.array([n]), whole], names=["which", "loss", "n", "gradient"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of several tasks' sums, model by model."""
    held: dict[int, tuple[float, float, np.ndarray]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            which, own = batch.column(0)[k].as_py(), batch.column(3)[k].values.to_numpy()
            loss, n, total = held.get(which, (0.0, 0.0, 0.0))
            held[which] = loss + batch.column(1)[k].as_py(), n + batch.column(2)[k].as_py(), total + own
    for which, sums in held.items():
        yield _sums(which, *sums)


# leaves of trees as features
def leaf_encoder(train: DataFrame, boosted: bool = False, trees: int = 50, depth: int = 10, keep: list[str] | None = None, columns: list[int] | None = None):
    """A transformer of samples whose ``features`` become one slot for each leaf of each tree, beside columns to ``keep``.

    ``columns`` restricts the trees to some of the features.
    """
    source = "features"
    stages = []
    if columns is not None:
        source = "_part"
        stages.append(VectorSlicer(inputCol="features", outputCol=source, indices=columns))
    if boosted:
        forest = GBTClassifier(featuresCol=source, maxIter=trees, maxDepth=depth, leafCol="_leaf", seed=SEED)
    else:
        forest = RandomForestClassifier(featuresCol=source, numTrees=trees, maxDepth=depth, maxBins=64, leafCol="_leaf", seed=SEED)
    fitted = Pipeline(stages=[*stages, forest]).fit(train)
    sizes = [(t.numNodes + 1) // 2 for t in fitted.stages[-1].trees]
    slots = [f"_leaf{k}" for k in range(len(sizes))]

    def spread(samples: DataFrame) -> DataFrame:
        out = fitted.transform(samples)
        kept = [c for c in samples.columns if c != "features"]
        leaves = vector_to_array("_leaf")
        out = out.select(*kept, F.col("features").alias("_raw"), *[leaves[k].alias(s) for k, s in enumerate(slots)])
        return out

    encoder = OneHotEncoder(inputCols=slots, outputCols=[f"{s}_hot" for s in slots], dropLast=False, handleInvalid="keep").fit(spread(train))
    assembler = VectorAssembler(inputCols=[*(["_raw"] if keep == ["features"] else keep or []), *[f"{s}_hot" for s in slots]], outputCol="features")

    def encode(samples: DataFrame) -> DataFrame:
        out = assembler.transform(encoder.transform(spread(samples)))
        return out.select(*samples.columns)

    return encode


def hybrid(train: DataFrame, fit_linear: Callable[[DataFrame], Model], **leaves) -> Model:
    """Leaves of trees, and a linear model on them."""
    encode = leaf_encoder(train, **leaves)
    model = fit_linear(encode(train))
    return lambda samples: model(encode(samples))


def sweep(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame, float], Model], values: list[float], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A measure for each value of a parameter, one below the other."""
    out = None
    for value in values:
        row = measure(fit(train, value)(test)).withColumn("parameter", F.lit(float(value)))
        out = row if out is None else out.unionByName(row)
    return out
