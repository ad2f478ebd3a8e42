"""Counts kept up over arriving files equal the batch counts."""

from pyspark.sql import functions as F

from strandline.sources import logs
from strandline.sources.fixtures import Views
from strandline.streaming.activity import daily_actions, read_log_stream

SF = "/root/testdata/sf0.001"


def run(spark, stream, path, mode):
    query = stream.writeStream.format("memory").queryName("daily").outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive
    return sorted((r.userid, str(r.date), r.clicktag, r.clickcount) for r in spark.table("daily").collect())


def test_arriving_files_equal_the_batch(spark, tmp_path):
    rows = Views(spark, SF).actions()
    lines = rows.select(F.concat_ws(logs.DELIMITER, F.lit("c"), "clicktag", "clicktime", F.col("userid").cast("string"), F.col("infoid").cast("string")).alias("value"))
    lines.repartition(5).write.text(f"{tmp_path}/log")
    stream = read_log_stream(spark, f"{tmp_path}/log", logs.ACTIONS, files_per_trigger=2)
    got = run(spark, daily_actions(stream, "60 days"), f"{tmp_path}/state", "complete")
    day = logs.day_of_epoch("clicktime")
    want = rows.groupBy(F.col("userid").cast("string").alias("userid"), day.alias("date"), "clicktag").agg(F.count("infoid").alias("n"))
    assert got == sorted((r.userid, str(r.date), r.clicktag, r.n) for r in want.collect())


def test_late_actions_are_dropped(spark, tmp_path):
    line = lambda user, second: logs.DELIMITER.join(["c", "click", f"{second}000", user, "7"])
    first = 1704067200  # a midnight
    parts = [[line("a", first), line("a", first + 5), line("a", 0).replace("0000", "none")], [line("b", first + 5 * 86400)], [line("a", first + 9), line("b", first + 5 * 86400 + 1)]]
    for k, part in enumerate(parts):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/log")
        stream = read_log_stream(spark, f"{tmp_path}/log", logs.ACTIONS, files_per_trigger=1)
        query = daily_actions(stream, "1 day").writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.userid, r.clickcount) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 2)]
