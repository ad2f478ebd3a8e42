"""Evaluation by date, and class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_by_date(predictions: DataFrame) -> DataFrame:
    """tp, fp, tn and fn by date, from hard labels and predictions."""
    of = lambda label, prediction: F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))
    return predictions.groupBy("date").agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(0, 0).alias("tn"), of(1, 0).alias("fn"))


def _rated(c: DataFrame) -> DataFrame:
    """Confusion counts with precision, recall, F1 and the area under the curve beside them, null where nothing is divided by."""
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    auc = (recall + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2
    rated = c.withColumns({"auc": auc, "precision": precision, "recall": recall})
    return rated.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_recall_by_date(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 by date, null where nothing is divided by."""
    return _rated(confusion_by_date(predictions)).select("date", "precision", "recall", "f1")


def auc_by_date(predictions: DataFrame) -> DataFrame:
    """Area under the curve of hard predictions, in closed form: the mean of the two classes' rates; null with one class."""
    return _rated(confusion_by_date(predictions)).select("date", "auc")


def evaluate(predictions: DataFrame) -> DataFrame:
    """All measures by date, in one pass over the predictions; rows without a date don't count."""
    rated = _rated(confusion_by_date(predictions.filter(F.col("date").isNotNull())))
    return rated.select("date", "auc", "precision", "recall", "f1", "tp", "fp", "tn", "fn").orderBy("date")


def class_counts(samples: DataFrame) -> DataFrame:
    """Positives, negatives and their ratio, null without negatives."""
    p, n = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return samples.agg(p.alias("positives"), n.alias("negatives"), F.try_divide(p, n).alias("ratio"))


def undersample(samples: DataFrame, ids: list[str], seed: int = 11) -> DataFrame:
    """All positives, and as many negatives, drawn by an MD5 of their ids, as there are positives, or all if there are fewer."""
    rate = samples.agg(F.least(F.lit(1.0), F.try_divide(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0))).alias("rate"))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))
    share = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return samples.crossJoin(F.broadcast(rate)).filter((F.col("label") == 1) | (share < F.coalesce("rate", F.lit(1.0)))).drop("rate")


def oversample(samples: DataFrame) -> DataFrame:
    """Each positive as often as negatives outnumber positives, once at least."""
    times = samples.agg(F.greatest(F.lit(1), F.coalesce(F.floor(F.try_divide(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1))), F.lit(1)).cast("int")).alias("times"))
    copies = F.when(F.col("label") == 1, F.col("times")).otherwise(1)
    return samples.crossJoin(F.broadcast(times)).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("times")


def class_weights(samples: DataFrame) -> DataFrame:
    """Weights inverse to the size of a row's class."""
    n = samples.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    weight = F.when(F.col("label") == 1, F.try_divide("q", F.col("p") + F.col("q"))).otherwise(F.try_divide("p", F.col("p") + F.col("q")))
    return samples.crossJoin(F.broadcast(n)).withColumn("weight", weight).drop("p", "q")


def time_weights(samples: DataFrame, decay: float = 0.1) -> DataFrame:
    """Weights that decay with the days before the latest."""
    latest = samples.agg(F.max(F.dayofyear("date")).alias("latest"))
    return samples.crossJoin(F.broadcast(latest)).withColumn("weight", F.exp(-decay * (F.col("latest") - F.dayofyear("date")))).drop("latest")
