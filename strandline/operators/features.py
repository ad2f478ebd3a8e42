"""Daily, period and match features, and their merge into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.sources.logs import day_of_epoch

#: The match features, and the statistics in the order of the feature vector.
MATCHES = ["rp_salary", "rp_education", "r_complete", "rr_salary", "rp_gender"]
STATISTICS = ["max", "var", "ave"]
PERIODS = ["click", "delivery", "download"]


# daily
def daily_clicks_by_tag(actions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Actions from a user's registration on, counted by resume, tag and day; times compare as text of equal length."""
    joined = actions.join(registrations, (actions.userid == registrations.userid) & (actions.clicktime >= registrations.adddate))
    return joined.groupBy("resumeid", day_of_epoch("clicktime").alias("date"), "clicktag").agg(F.count("infoid").alias("clickcount"))


def clicks_after_registration(actions: DataFrame, registrations: DataFrame) -> DataFrame:
    joined = actions.join(registrations, (actions.userid == registrations.userid) & (actions.clicktime >= registrations.adddate))
    return joined.select("resumeid", "clicktag", "clicktime", "infoid")


def delivery_days(deliveries: DataFrame) -> DataFrame:
    return deliveries.select("userid", "resumeid", "positionid", day_of_epoch("deliverytime").alias("date"))


def within(df: DataFrame, first: str, last: str, date_col: str = "date") -> DataFrame:
    """Rows of a range of days; a range, not a pattern, so that it can be pushed to the scan."""
    return df.filter(F.col(date_col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def download_days(downloads: DataFrame) -> DataFrame:
    """Each download with the number of downloads of its resume on its day."""
    day = downloads.withColumn("date", F.to_date("downtime"))
    return day.withColumn("downcount", F.count("downtime").over(Window.partitionBy("resumeid", "date"))).select("resumeid", "date", "downcount", "entuserid")


def daily_clicks(by_tag: DataFrame) -> DataFrame:
    return by_tag.groupBy("resumeid", "date").agg(F.sum("clickcount").alias("daily_count"))


def daily_deliveries(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("resumeid", "date").agg(F.count("positionid").alias("daily_count"))


# periods of three days
def _period(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.sum("daily_count").alias(f"sum_{name}"), F.stddev_pop("daily_count").alias(f"std_{name}"), F.max("daily_count").alias(f"max_{name}"), F.count("daily_count").alias("n")).filter("n = 3").drop("n")


def period_of_daily(daily: DataFrame, name: str, days: int = 3, backward: bool = False) -> DataFrame:
    """Sum, population deviation and maximum over a day and the next two, where all three days have a row.

    One window frame over unique daily rows: one shuffle and no copies. ``backward`` looks back instead.
    """
    frame = Window.partitionBy("resumeid").orderBy(F.unix_date("date"))
    frame = frame.rangeBetween(1 - days, 0) if backward else frame.rangeBetween(0, days - 1)
    of = {"sum": F.sum, "std": F.stddev_pop, "max": F.max}
    out = daily.select("resumeid", "date", *[f("daily_count").over(frame).alias(f"{k}_{name}") for k, f in of.items()], F.count("daily_count").over(frame).alias("n"))
    return out.filter(F.col("n") == days).drop("n")


def period_of_rows(rows: DataFrame, name: str, days: int = 3) -> DataFrame:
    """The same over rows that aren't unique by day: each counts for its day and the two before, and three must meet.

    Days without a row of their own can come out, so this isn't a frame.
    """
    shifted = rows.select("resumeid", F.explode(F.array(*[F.date_sub("date", k) for k in range(days)])).alias("date"), "daily_count")
    return _period(shifted.groupBy("resumeid", "date"), name)


def time_series(clicks: DataFrame, deliveries: DataFrame, downloads: DataFrame) -> DataFrame:
    """All period features by resume and day, 0 where a kind has none."""
    joined = clicks.filter("resumeid is not null").join(deliveries.filter("resumeid is not null"), ["resumeid", "date"], "full").join(downloads, ["resumeid", "date"], "full")
    return joined.select("resumeid", "date", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in joined.columns if c not in ("resumeid", "date")])


# matches
def match_columns(male: str = "hot", female: str = "cold") -> list[Column]:
    c = F.col
    values = [S.code_distance(c("targetsalary"), c("salary")), S.code_distance(c("r_education"), c("p_education")), S.completeness_match(), S.code_distance(c("targetsalary"), c("nowsalary")), S.gender_weight(c("gender"), S.title_gender(c("title"), male, female))]
    return [v.alias(n) for n, v in zip(MATCHES, values, strict=True)]


def delivery_matches(deliveries: DataFrame, resumes: DataFrame, positions: DataFrame) -> DataFrame:
    """Match features of each distinct delivery of a resume to a position on a day."""
    distinct = deliveries.select("resumeid", "positionid", "date").distinct()
    return distinct.join(resumes, "resumeid").join(positions, "positionid").select("resumeid", "date", "positionid", *match_columns())


def download_matches(downloads: DataFrame, resumes: DataFrame, positions: DataFrame, key: str = "entuserid") -> DataFrame:
    """Match features of each distinct download with all positions of the entity that downloaded."""
    distinct = downloads.select("resumeid", F.col(key).alias("entid"), "date").distinct()
    return distinct.join(resumes, "resumeid").join(positions, "entid").select("resumeid", "date", "positionid", *match_columns())


def match_statistics(matches: DataFrame) -> DataFrame:
    """Maximum, population variance and mean of each match feature by resume and day, in one aggregation."""
    of = {"max": F.max, "var": F.var_pop, "ave": F.avg}
    return matches.groupBy("resumeid", "date").agg(*[of[s](m).alias(f"{s}_{m}") for s in STATISTICS for m in MATCHES])


# merge
def feature_names() -> list[str]:
    periods = [f"period_{p}_{s}" for p in PERIODS for s in ("count", "std", "max")]
    return ["click_count", "delivery_count", "download_count", *periods, *[f"{side}_{s}_match_{m}" for side in ("delivery", "download") for s in STATISTICS for m in MATCHES]]


def id_spine(*tables: DataFrame) -> DataFrame:
    """All pairs of resume and day that any table has."""
    return reduce(DataFrame.union, [t.select("resumeid", "date") for t in tables]).distinct()


def feature_merge(clicks: DataFrame, deliveries: DataFrame, downloads: DataFrame, series: DataFrame, delivery_stats: DataFrame, download_stats: DataFrame, faithful: bool = True) -> DataFrame:
    """The 42 features by resume and day.

    Joining the details of a day multiplies its sums by the other details' numbers of rows. ``faithful`` reproduces
    those products, by counting rows instead of joining them; else each kind is counted by itself.
    """
    keys = ["resumeid", "date"]
    spine = id_spine(clicks, deliveries, downloads, series, delivery_stats, download_stats)
    per_click = clicks.groupBy(keys).agg(F.sum("clickcount").alias("c_sum"), F.count(F.lit(1)).alias("c_rows"))
    per_delivery = deliveries.groupBy(keys).agg(F.count("positionid").alias("d_sum"), F.count(F.lit(1)).alias("d_rows"))
    per_download = downloads.groupBy(keys).agg(F.max("downcount").alias("w_sum"), F.count(F.lit(1)).alias("w_rows"))
    rename = lambda df, side: df.select(*keys, *[F.col(f"{s}_{m}").alias(f"{side}_{s}_match_{m}") for s in STATISTICS for m in MATCHES])
    joined = spine
    for side in (per_click, per_delivery, per_download, series, rename(delivery_stats, "delivery"), rename(download_stats, "download")):
        joined = joined.join(side, keys, "left")
    many = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(0))) if faithful else F.lit(1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    plural = {"click": "clicks", "delivery": "deliveries", "download": "downloads"}
    periods = [zero(f"{k}_{plural[p]}").alias(f"period_{p}_{n}") for p in PERIODS for n, k in (("count", "sum"), ("std", "std"), ("max", "max"))]
    return joined.select(
        F.col("resumeid").alias("resume_id"),
        "date",
        (zero("c_sum") * many("d_rows") * many("w_rows")).alias("click_count"),
        (zero("d_sum") * many("c_rows") * many("w_rows")).alias("delivery_count"),
        zero("w_sum").alias("download_count"),
        *periods,
        *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in feature_names()[12:]],
    )


def similar_resume_data(delivery_stats: DataFrame, download_stats: DataFrame, known: DataFrame) -> DataFrame:
    """The 30 match features of the known resumes, by resume and day."""
    keys = ["resumeid", "date"]
    spine = id_spine(delivery_stats, download_stats).join(known.select("resumeid").distinct(), "resumeid", "left_semi")
    rename = lambda df, side: df.select(*keys, *[F.col(f"{s}_{m}").alias(f"{side}_{s}_match_{m}") for s in STATISTICS for m in MATCHES])
    joined = spine.join(rename(delivery_stats, "delivery"), keys, "left").join(rename(download_stats, "download"), keys, "left")
    return joined.select("resumeid", "date", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in feature_names()[12:]])
