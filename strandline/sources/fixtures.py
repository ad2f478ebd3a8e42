"""The log views, mapped from the synthetic tables (see FIXTURES.md). Ids are integers; codes and epochs are text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.logs import DELIMITER

#: Epochs in milliseconds, as text: registration of even and of odd ids.
EARLY, LATE = "1701388800000", "1705276800000"
#: Days that labels and features are about, and the first test day.
FIRST_DAY, LAST_DAY, DIVIDER = "2024-01-01", "2024-01-31", "2024-01-25"


class Views:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _events(self, *kinds: str) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
        millis = F.expr("cast(timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as string)")
        return self.table("events").filter(F.col("event_type").isin(*kinds)).select("user_id", "event_type", "ts", k.alias("k"), millis.alias("millis"))

    def actions(self) -> DataFrame:
        return self._events("click", "view", "error").select(F.col("user_id").alias("userid"), F.col("event_type").alias("clicktag"), F.col("millis").alias("clicktime"), F.col("k").alias("infoid"))

    def registrations(self) -> DataFrame:
        added = F.when(F.col("c_custkey") % 2 == 0, EARLY).otherwise(LATE)
        return self.table("customer").select(F.col("c_custkey").alias("resumeid"), F.col("c_custkey").alias("userid"), added.alias("adddate"))

    def deliveries(self) -> DataFrame:
        return self._events("purchase").select(F.col("user_id").alias("userid"), F.col("user_id").alias("resumeid"), F.col("k").alias("positionid"), F.col("millis").alias("deliverytime"))

    def downloads(self) -> DataFrame:
        return self._events("signup").select(F.col("user_id").alias("resumeid"), F.col("k").alias("entuserid"), F.col("ts").alias("downtime"))

    def resumes(self) -> DataFrame:
        gender = F.when(F.col("c_mktsegment") == "MACHINERY", "-").when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "0").otherwise("1")
        code = lambda col, m: (F.col(col) % m).cast("string")
        return self.table("customer").select(F.col("c_custkey").alias("resumeid"), code("c_custkey", 10).alias("targetsalary"), code("c_nationkey", 10).alias("nowsalary"), code("c_nationkey", 7).alias("r_education"), gender.alias("gender"), code("c_custkey", 100).alias("complete"))

    def positions(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("positionid"), F.floor(F.col("p_partkey") / 4).cast("bigint").alias("entid"), (F.col("p_size") % 10).cast("string").alias("salary"), (F.col("p_size") % 7).cast("string").alias("p_education"), F.col("p_name").alias("title"))

    # raw lines, some of which the layouts reject: too short, too long, or with blanks at the end
    def resume_lines(self) -> DataFrame:
        k, nation, x = F.col("c_custkey"), F.col("c_nationkey"), F.lit("x")
        gender = F.when(F.col("c_mktsegment") == "MACHINERY", "-").when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "0").otherwise("1")
        added = F.when(k % 2 == 0, EARLY).otherwise(LATE)
        head = [F.when(k % 19 == 0, "-").otherwise(k.cast("string")), k, F.col("c_mktsegment"), nation, F.lit("p"), k % 10, nation % 7, x, x, x, x, gender, x, k % 3, x, x, nation, k % 100, x]
        rest = [added, nation % 10, *[x] * 12, F.when(k % 11 == 0, "").otherwise("z"), F.when(k % 13 == 0, "y")]
        short = F.concat_ws(DELIMITER, *[c.cast("string") for c in head])
        full = F.concat_ws(DELIMITER, short, *[c.cast("string") for c in rest])
        return self.table("customer").select(k.alias("key"), F.when(k % 17 == 0, short).otherwise(full).alias("value"))

    def position_lines(self) -> DataFrame:
        p, size, x = F.col("p_partkey"), F.col("p_size"), F.lit("x")
        added, posted = F.when(p % 2 == 0, EARLY).otherwise(LATE), F.when(p % 3 == 0, LATE).otherwise(EARLY)
        fields = [F.when(p % 23 == 0, "-").otherwise(p.cast("string")), added, F.col("p_brand"), F.col("p_type"), F.lit("c"), x, F.col("p_name"), F.floor(p / 4), posted, *[x] * 5, size % 10, size % 7, size, F.lit("m"), *[x] * 5, F.when(p % 9 == 0, "").otherwise("z")]
        return self.table("part").select(F.concat_ws(DELIMITER, *[c.cast("string") for c in fields]).alias("value"))

    def download_lines(self) -> DataFrame:
        rows, x = self.downloads(), F.lit("x")
        down = F.when(F.col("entuserid") % 8 == 0, "").otherwise(F.date_format("downtime", "yyyy-MM-dd HH:mm:ss"))
        fields = [x, x, F.col("entuserid"), x, F.floor(F.col("entuserid") / 4), x, x, F.col("resumeid"), F.col("resumeid"), x, x, x, down]
        return rows.select(F.concat_ws(DELIMITER, *[c.cast("string") for c in fields]).alias("value"))

    def delivery_lines(self) -> DataFrame:
        rows, k = self.deliveries(), F.col("positionid")
        fields = [F.lit("c"), k, F.floor(k / 4), F.col("resumeid"), F.col("userid"), F.col("deliverytime"), F.when(k % 6 == 0, "").otherwise((k % 5).cast("string"))]
        return rows.select(F.concat_ws(DELIMITER, *[c.cast("string") for c in fields]).alias("value"))
