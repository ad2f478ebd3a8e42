"""Delimited logs: positional fields, rows kept by their number of fields, and the views that features start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITER = "\u0001"


@dataclass(frozen=True)
class Layout:
    """Which fields of a line become which columns, and how many fields a line must have."""

    columns: dict[str, int]
    least: int
    exactly: bool = False


# The input formats' field positions.
ACTIONS = Layout({"cookieid": 0, "clicktag": 1, "clicktime": 2, "userid": 3, "infoid": 4}, 5)
REGISTRATIONS = Layout({"resumeid": 0, "userid": 1, "adddate": 19}, 20)
RESUMES = Layout({"resumeid": 0, "userid": 1, "nowposition": 2, "targetcategory": 3, "targetposition": 4, "targetsalary": 5, "education": 6, "gender": 11, "jobstate": 13, "areaid": 16, "complete": 17, "nowsalary": 20}, 34, True)
POSITIONS = Layout({"infoid": 0, "adddate": 1, "cate1": 2, "cate2": 3, "cate3": 4, "title": 6, "entid": 7, "salary": 14, "education": 15, "experience": 16, "trade": 17}, 24)
POSITION_COUNTS = Layout({"infoid": 0, "adddate": 1, "cate1": 2, "cate2": 3, "cate3": 4, "title": 6, "postdate": 8}, 24)
DOWNLOADS = Layout({"entuserid": 2, "entid": 4, "resumeuserid": 7, "resumeid": 8, "downtime": 12}, 13)
DELIVERIES = Layout({"cookieid": 0, "infoid": 1, "entuserid": 2, "resumeid": 3, "resumeuserid": 4, "deliverytime": 5, "slot": 6}, 7)
SIMILAR = Layout({"resumeid": 0, "date": 1, "n1": 2, "n2": 3, "n3": 4}, 5)


def fields(line: Column) -> Column:
    """Fields of a line without its trailing empty ones, which don't count towards the number of fields."""
    return F.split(F.regexp_replace(line, f"{DELIMITER}+$", ""), DELIMITER, -1)


def parse(lines: DataFrame, layout: Layout, line_col: str = "value") -> DataFrame:
    """Columns of ``layout`` from a column of lines; lines with another number of fields are dropped."""
    split = lines.select(fields(F.col(line_col)).alias("f"))
    size = F.size("f")
    kept = split.filter(size == layout.least if layout.exactly else size >= layout.least)
    return kept.select(*[F.col("f")[at].alias(name) for name, at in layout.columns.items()])


def read_log(spark: SparkSession, paths: str | list[str], layout: Layout) -> DataFrame:
    """Read and parse log files; paths may hold globs, and a comma joins several in one string."""
    paths = paths.split(",") if isinstance(paths, str) else paths
    return parse(spark.read.text(paths), layout)


def parse_pairs(lines: DataFrame) -> DataFrame:
    """resumeid, positionid, time and flag of click and delivery pairs; lines whose ids aren't numbers are dropped."""
    raw = parse(lines, Layout({"resumeid": 0, "positionid": 1, "time": 2, "flag": 3}, 4))
    typed = raw.select(*[F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("resumeid", "positionid", "time")], "flag")
    return typed.filter("resumeid is not null and positionid is not null and time is not null")


def parse_labelled(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """id, date (an integer like 20240131), label and features from lines like ``[id,20240131,(1.0, 2.0, 3.0)]``.

    A line whose date is no day, or whose numbers aren't all numbers, gives date -1, label 0 and as many zeros as it has numbers,
    the label included.
    """
    parts = F.split(line_col, ",")
    numbers = F.split(F.regexp_extract(line_col, r"\(([^)]*)\)", 1), ", ")
    raw = lines.select(F.substring_index(F.get(parts, 0), "[", -1).alias("id"), F.get(parts, 1).alias("day"), numbers.alias("raw")).withColumn("x", F.transform("raw", lambda v: v.try_cast("double")))
    good = F.col("day").rlike("^[0-9]{8}$") & F.try_to_timestamp("day", F.lit("yyyyMMdd")).isNotNull() & F.forall("x", lambda v: v.isNotNull())
    rows = raw.withColumn("good", F.coalesce(good, F.lit(False)))
    pick = lambda value, other: F.when(F.col("good"), value).otherwise(other)
    return rows.select("id", pick(F.col("day").try_cast("int"), -1).alias("date"), pick(F.get("x", F.lit(0)), 0.0).alias("label"), pick(F.slice("x", 2, F.size("x")), F.transform("raw", lambda v: F.lit(0.0))).alias("features"))


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))


def parse_history(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """resumeid, clicks and deliveries from lines like ``(id,(WrappedArray(1.0, 0.0),WrappedArray(0.0, 2.0)))``."""
    arrays = F.regexp_extract_all(line_col, F.lit(r"WrappedArray\(([^)]*)\)"), 1)
    return lines.select(F.expr(f"substr(substring_index({line_col}, ',', 1), 2)").alias("resumeid"), _numbers(F.get(arrays, F.lit(0))).alias("clicks"), _numbers(F.get(arrays, F.lit(1))).alias("deliveries"))


def parse_factors(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """id and v from lines like ``(id,WrappedArray(0.5, 0.25))``."""
    v = F.regexp_extract(line_col, r"WrappedArray\(([^)]*)\)", 1)
    return lines.select(F.expr(f"substr(substring_index({line_col}, ',', 1), 2)").alias("id"), _numbers(v).alias("v"))


def read_parquet(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """Parquet files under paths, which may hold globs; columns in the folders' names below ``base`` are kept."""
    reader = spark.read.option("basePath", base) if base else spark.read
    return reader.parquet(*paths)


def present(col: str) -> Column:
    """Neither null nor the sentinel for it."""
    return F.col(col) != "-"


def day_of_epoch(col: str) -> Column:
    """The day (UTC) of an epoch text, of which the first ten characters are seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.expr(f"try_cast(substr({col}, 1, 10) as bigint)") / 86400).cast("int"))
