"""Activity labels, labelled samples and the choice of ids and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_days(by_tag: DataFrame, deliveries: DataFrame, threshold: int = 3) -> DataFrame:
    """Days with at least ``threshold`` rows of clicks by tag, or with any delivery."""
    often = by_tag.groupBy("resumeid", "date").count().filter(F.col("count") >= threshold).select("resumeid", "date")
    return often.union(deliveries.select("resumeid", "date")).distinct()


def label_horizon(active: DataFrame, days: int = 3) -> DataFrame:
    """The days whose next ``days`` days hold an active one."""
    return active.select("resumeid", F.explode(F.array(*[F.date_sub("date", k) for k in range(1, days + 1)])).alias("date")).distinct()


def labelled(features: DataFrame, positive: DataFrame) -> DataFrame:
    """Features with label 1 where the day is positive, else 0."""
    marks = positive.select(F.col("resumeid").alias("resume_id"), "date", F.lit(1.0).alias("label"))
    return features.join(marks, ["resume_id", "date"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def labelled_full(features: DataFrame, active: DataFrame) -> DataFrame:
    """Full outer join of a day's features with the next day's activity, '0' where there is none."""
    marks = active.select(F.col("resumeid").alias("a_id"), F.col("date").alias("a_date"), F.lit("1").alias("activeness"))
    joined = marks.join(features, (F.col("a_id") == F.col("resume_id")) & (F.col("a_date") == F.date_add("date", 1)), "full")
    return joined.select(F.coalesce("activeness", F.lit("0")).alias("activeness"), *features.columns)


def valid_ids(rows: DataFrame, more_than: int = 3, id_col: str = "resume_id") -> DataFrame:
    """Rows of ids that have more than ``more_than`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return rows.withColumn("_n", n).filter(F.col("_n") > more_than).drop("_n")


def date_split(rows: DataFrame, divider: str, exclusive: bool = False, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """Training rows up to the divider and test rows from it on; the divider is in both unless ``exclusive``."""
    day = F.lit(divider).cast("date")
    return rows.filter(F.col(date_col) < day if exclusive else F.col(date_col) <= day), rows.filter(F.col(date_col) >= day)


#: Feature groups by tag: base, match and history, where the history-and-match tag may start one match feature late.
def slice_features(vector, history, tag: str, faithful: bool = True):
    """Columns of arrays sliced by a tag: B, M, BM, BH, HM or MH, BHM or BMH."""
    base, match = F.slice(vector, 1, 12), F.slice(vector, 13, 30)
    late = F.slice(vector, 14, 29) if faithful else match
    of = {"B": base, "M": match, "BM": vector, "BH": F.concat(base, history), "HM": F.concat(late, history), "MH": F.concat(late, history), "BHM": F.concat(vector, history), "BMH": F.concat(vector, history)}
    if tag not in of:
        raise ValueError(f"no such feature tag: {tag}")
    return of[tag]
