"""Histories: per resume, two arrays over the observed days, and what is computed from them by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clicks that make a day active; days of a feature window; days that a label looks ahead.
CLICKS, WINDOW, AHEAD = 3, 5, 3


def history_vectors(by_tag: DataFrame, deliveries: DataFrame) -> DataFrame:
    """resumeid, dates, clicks and deliveries: rows by day over all observed days, 0 where a resume has none.

    One aggregation and a lookup along the axis of days, which is as long as there are days.
    """
    daily = by_tag.select("resumeid", "date", F.lit(1).alias("c"), F.lit(0).alias("d")).union(deliveries.select("resumeid", "date", F.lit(0), F.lit(1)))
    daily = daily.groupBy("resumeid", "date").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    axis = daily.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    maps = daily.groupBy("resumeid").agg(F.map_from_entries(F.collect_list(F.struct("date", F.struct("c", "d")))).alias("m"))
    of = lambda k: F.transform("dates", lambda day: F.coalesce(F.try_element_at("m", day)[k], F.lit(0)))
    return maps.crossJoin(F.broadcast(axis)).select("resumeid", "dates", of("c").alias("clicks"), of("d").alias("deliveries"))


def resume_dates(histories: DataFrame) -> DataFrame:
    """Every resume with every observed day, by unrolling each resume's axis."""
    return histories.select("resumeid", F.explode("dates").alias("date"))


def _active(c: Column, d: Column) -> Column:
    return (c >= CLICKS) | (d > 0)


def _states() -> Column:
    """Booleans: is the day active?"""
    return F.zip_with("clicks", "deliveries", _active)


def _interleaved(first: Column, days: int) -> Column:
    """Clicks and deliveries of ``days`` days from index ``first`` (0-based), oldest first; days before the axis are 0."""
    at = lambda a, i: F.when(i >= 0, F.coalesce(F.get(a, i), F.lit(0))).otherwise(0)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda j: F.array(at("clicks", first + j), at("deliveries", first + j))))


def _any(first: Column, days: int) -> Column:
    """Is any of ``days`` days from index ``first`` active? Days off the axis aren't."""
    low = F.greatest(first, F.lit(0))
    return F.exists(F.slice("active", low + 1, F.greatest(F.lit(0), first + days - low)), lambda x: x)


def day_rows(histories: DataFrame) -> DataFrame:
    return histories.withColumn("active", _states()).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("dates") - 1)))


def history_features(histories: DataFrame, days: int = WINDOW) -> DataFrame:
    """The last ``days`` days' clicks and deliveries of each resume and day."""
    rows = day_rows(histories)
    first = F.col("i") - (days - 1)
    return rows.select("resumeid", F.get("dates", F.col("i")).alias("date"), "i", _interleaved(first, days).alias("history"), _any(first, days).alias("history_active"))


def training_windows(histories: DataFrame, days: int = WINDOW, ahead: int = AHEAD, test: bool = False) -> DataFrame:
    """Sliding windows with an active day: their end (or, for the test windows, their number), label and features."""
    split = days + 7
    rows = day_rows(histories).withColumn("n", F.size("dates"))
    rows = rows.filter((F.col("i") >= F.col("n") - split) & (F.col("i") < F.col("n") - days - 2) & (F.col("n") >= split) if test else F.col("i") < F.col("n") - split)
    day = F.col("i") - (F.col("n") - split) if test else F.col("i") + days - 1
    return rows.filter(_any(F.col("i"), days)).select("resumeid", day.alias("day"), _any(F.col("i") + days, ahead).cast("double").alias("label"), _interleaved(F.col("i"), days).alias("features"))


def append_history(samples: DataFrame, histories: DataFrame, days: int = WINDOW, ahead: int = WINDOW) -> DataFrame:
    """Labelled samples with the history up to their day; resumes without samples get one row for each day.

    Only rows whose history window is active stay. Samples of resumes without a history, or of days off the axis, go.
    The rows that are made up are labelled by the next ``ahead`` days and have no features.
    """
    rows = history_features(histories, days)
    own = samples.withColumnRenamed("resume_id", "resumeid").join(rows, ["resumeid", "date"]).filter("history_active")
    features = [c for c in samples.columns if c not in ("resume_id", "date", "label")]
    without = day_rows(histories.join(samples.select(F.col("resume_id").alias("resumeid")).distinct(), "resumeid", "left_anti"))
    first = F.col("i") - (days - 1)
    made = without.filter(_any(first, days)).select("resumeid", F.get("dates", F.col("i")).alias("date"), _any(F.col("i") + 1, ahead).cast("double").alias("label"), _interleaved(first, days).alias("history"), F.lit(True).alias("made_up"), *[F.lit(0.0).alias(c) for c in features])
    return own.select("resumeid", "date", "label", "history", F.lit(False).alias("made_up"), *features).unionByName(made)


# activity analytics; x marks days with a click or a delivery
def _marks(histories: DataFrame) -> DataFrame:
    return histories.select("resumeid", F.zip_with("clicks", "deliveries", lambda c, d: (c > 0) | (d > 0)).alias("x"))


def _histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length")


def active_day_histogram(histories: DataFrame) -> DataFrame:
    return _histogram(_marks(histories).select(F.size(F.filter("x", lambda x: x)).cast("bigint").alias("length")))


def continuous_runs(histories: DataFrame) -> DataFrame:
    """Lengths of runs of active days that bridge gaps of one day, which count; a run open at the end isn't counted."""
    n = F.size("x")
    zero = F.struct(F.lit(0).cast("bigint").alias("c"), F.array().cast("array<bigint>").alias("out"))

    def step(s, i):
        now, then = F.get("x", i), F.coalesce(F.get("x", i + 1), F.lit(False))
        runs = s["c"] > 0
        return (
            F.when(now | (runs & then), F.struct((s["c"] + 1).alias("c"), s["out"].alias("out")))
            .when(runs, F.struct(F.lit(0).cast("bigint").alias("c"), F.concat(s["out"], F.array(s["c"])).alias("out")))
            .otherwise(s)
        )

    folded = F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda s: s["out"])
    return _histogram(_marks(histories).select(F.explode(folded).alias("length")))


def activity_spans(histories: DataFrame) -> DataFrame:
    """Days from the first to the last active one."""
    at = F.filter(F.transform("x", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    spans = _marks(histories).select((F.array_max(at) - F.array_min(at)).cast("bigint").alias("length"))
    return _histogram(spans.filter("length is not null"))


def span_ratios(histories: DataFrame) -> DataFrame:
    """The share of each span among all; the total is of one row for each length."""
    hist = activity_spans(histories)
    total = hist.agg(F.sum("n").alias("total"))
    return hist.crossJoin(F.broadcast(total)).select("length", (F.col("n") / F.col("total")).alias("ratio"))


def returns_after_pause(histories: DataFrame, past: int = 5, pause: int = 3) -> DataFrame:
    """Of the idle days that begin a pause after some activity: how many never saw activity again, and how many there are."""
    rows = _marks(histories).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("x") - 1)))
    i, low = F.col("i"), F.greatest(F.col("i") - past, F.lit(0))
    some = lambda first, size: F.exists(F.slice("x", first + 1, size), lambda x: x)
    seen = rows.filter(~F.get("x", i) & some(low, i - low) & ~some(i, F.lit(pause)))
    again = some(i + pause, F.size("x"))
    return seen.agg(F.count_if(~again).alias("gone"), F.count(F.lit(1)).alias("total"))


def power_sessions(histories: DataFrame) -> DataFrame:
    """Lengths of sessions that gain energy on active days and burn it on idle ones; an idle day without any ends one."""
    long = lambda v: F.lit(v).cast("bigint")
    state = lambda pw, ln, la, fi, out: F.struct(pw.alias("pw"), ln.alias("ln"), la.alias("la"), fi.alias("fi"), out.alias("out"))
    zero = state(long(0), long(0), long(0), long(0), F.array().cast("array<bigint>"))

    def step(s, i):
        active = state(s["pw"] + 1, s["ln"] + 1, i.cast("bigint"), F.when(s["ln"] == 0, i.cast("bigint")).otherwise(s["fi"]), s["out"])
        burn = state(s["pw"] - 1, s["ln"], s["la"], s["fi"], s["out"])
        end = state(s["pw"], long(0), s["la"], s["fi"], F.concat(s["out"], F.array(s["la"] - s["fi"] + 1)))
        return F.when(F.get("x", i), active).when(s["pw"] > 0, burn).when(s["ln"] > 0, end).otherwise(s)

    finish = lambda s: F.when(s["ln"] > 0, F.concat(s["out"], F.array(s["la"] - s["fi"] + 1))).otherwise(s["out"])
    folded = F.aggregate(F.sequence(F.lit(0), F.size("x") - 1), zero, step, finish)
    return _histogram(_marks(histories).select(F.explode(folded).alias("length")))


def entities_per_day(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy("date").agg(F.countDistinct(id_col).alias("n"))
