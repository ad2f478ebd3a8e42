"""Daily actions while the log is still being written: the batch counts by day, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import logs


def read_log_stream(spark: SparkSession, path: str, layout: logs.Layout, files_per_trigger: int = 1000) -> DataFrame:
    """Delimited lines of files as they arrive in a folder, parsed like :func:`~strandline.sources.logs.read_log`."""
    return logs.parse(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), layout)


def daily_actions(actions: DataFrame, late: str = "1 day") -> DataFrame:
    """userid, date, clicktag and clickcount of a stream of actions.

    Actions that come more than ``late`` after the latest one seen are dropped, which bounds the state: a day's counts are
    final, and given up, once the watermark has passed it. Days are UTC; actions without a valid time are dropped.
    """
    seconds = F.expr("try_cast(substr(clicktime, 1, 10) as bigint)")
    timed = actions.withColumn("at", F.timestamp_seconds(seconds)).filter("at is not null").withWatermark("at", late)
    counted = timed.groupBy(F.window("at", "1 day"), "userid", "clicktag").agg(F.count("infoid").alias("clickcount"))
    return counted.select("userid", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_timestamp("window.start") / 86400).cast("int")).alias("date"), "clicktag", "clickcount")
