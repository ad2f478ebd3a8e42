"""The feature, history and graph layers: definitions by hand, equivalent forms, and DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import evaluation as E
from strandline.operators import features as X
from strandline.operators import graph as G
from strandline.operators import history as H
from strandline.operators import labels as L
from strandline.plans.oracles import ORACLES
from strandline.plans.queries import QUERIES
from strandline.sources import logs, sinks

SF = "/root/testdata/sf0.001"


def day(text: str):
    return F.lit(text).cast("date")


def cell(value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{value + 0.0:.4f}"
    return str(value)[:10] if hasattr(value, "year") else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted(tuple(cell(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    b = sorted(tuple(cell(r[k]) for k in at) for r in want.fetchall())
    assert a == b


def test_lines_drop_trailing_blanks(spark):
    lines = spark.createDataFrame([("a\1b\1c\1d\1",), ("a\1b\1c\1d\1e",), ("a\1\1c\1d\1e\1\1",), ("",), (None,)], "value string")
    assert [tuple(r) for r in logs.parse(lines, logs.ACTIONS).collect()] == [("a", "b", "c", "d", "e"), ("a", "", "c", "d", "e")]
    assert logs.parse(lines, logs.Layout({"x": 0}, 4, True)).count() == 1


def test_pairs_with_bad_numbers_go(spark):
    lines = spark.createDataFrame([("1\0012\0013\1C",), ("x\0012\0013\1D",), ("1\0012\1\1D",)], "value string")
    assert [tuple(r) for r in logs.parse_pairs(lines).collect()] == [(1, 2, 3, "C")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", None), (2, "2024-01-02", 0.5)], "id long, date string, x double")
    sinks.write_by_date(df, f"{tmp_path}/by", files_per_date=2)
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/by/date=*")) == ["date=2024-01-01", "date=2024-01-02"]
    sinks.write_single(df, f"{tmp_path}/one")
    assert len(glob.glob(f"{tmp_path}/one/*.parquet")) == 1
    sinks.write_lines(df, f"{tmp_path}/lines")
    sinks.write_lines(df, f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["1\0012024-01-01\1-", "2\0012024-01-02\0010.5"]
    assert tuple(sinks.counters(df, "id").first()) == (2, 2)
    assert logs.read_log(spark, f"{tmp_path}/lines,{tmp_path}/lines", logs.Layout({"id": 0}, 3)).count() == 4


def daily(spark, rows):
    return spark.createDataFrame(rows, "resumeid long, d string, daily_count long").select("resumeid", F.col("d").cast("date").alias("date"), "daily_count")


def test_period_of_consecutive_days(spark):
    rows = daily(spark, [(1, "2024-01-01", 1), (1, "2024-01-02", 2), (1, "2024-01-03", 3), (2, "2024-01-01", 1), (2, "2024-01-02", 1), (2, "2024-01-04", 1)])
    got = X.period_of_daily(rows, "x").collect()
    assert [(r.resumeid, str(r.date), r.sum_x, r.max_x, round(r.std_x, 4)) for r in got] == [(1, "2024-01-01", 6, 3, 0.8165)]
    assert [str(r.date) for r in X.period_of_daily(rows, "x", backward=True).collect()] == ["2024-01-03"]


def test_frame_and_shifts_agree_on_unique_days(spark):
    rows = daily(spark, [(i, f"2024-01-{d:02d}", (i * d) % 5) for i in range(5) for d in range(1, 29) if (i + d) % 4])
    a, b = X.period_of_daily(rows, "x"), X.period_of_rows(rows, "x")
    assert a.count() and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_downloads_of_one_day_fan_out(spark):
    got = X.period_of_rows(daily(spark, [(1, "2024-01-10", 3)] * 3), "x").collect()
    assert sorted((str(r.date), r.sum_x, r.std_x, r.max_x) for r in got) == [("2024-01-08", 9, 0.0, 3), ("2024-01-09", 9, 0.0, 3), ("2024-01-10", 9, 0.0, 3)]


def test_merge_fan_out(spark):
    d = day("2024-01-05")
    clicks = spark.createDataFrame([(1, "a", 5), (1, "b", 7)], "resumeid long, clicktag string, clickcount long").withColumn("date", d)
    sent = spark.createDataFrame([(1, 1, k) for k in range(3)], "userid long, resumeid long, positionid long").withColumn("date", d)
    none = spark.createDataFrame([], "resumeid long, downcount long, entuserid long").withColumn("date", d)
    periods = X.time_series(X.period_of_daily(X.daily_clicks(clicks), "clicks"), X.period_of_daily(X.daily_deliveries(sent), "deliveries"), X.period_of_rows(none.withColumnRenamed("downcount", "daily_count"), "downloads"))
    stats = X.match_statistics(spark.createDataFrame([], "resumeid long, " + ", ".join(f"{m} double" for m in X.MATCHES)).withColumn("date", d))
    for faithful, want in ((True, (36, 6)), (False, (12, 3))):
        row = X.feature_merge(clicks, sent, none, periods, stats, stats, faithful).first()
        assert (row.click_count, row.delivery_count) == want
        assert len(row) == 44


def test_codes_and_genders(spark):
    pairs = spark.createDataFrame([("3", "5"), ("100", "5"), ("-", "5"), ("", "5"), (None, "5")], "a string, b string")
    assert [r[0] for r in pairs.select(S.code_distance(F.col("a"), F.col("b"))).collect()] == [2, 0, 0, 0, 0]
    cases = spark.createDataFrame([("-", -1), ("-", 0), ("-", 1), ("0", -1), ("0", 0), ("0", 1), ("x", 1)], "r string, p int")
    assert [round(r[0], 6) for r in cases.select(S.gender_weight(F.col("r"), F.col("p"))).collect()] == [0, -0.1, 0.1, -1.5, 1, -1, -1]


def test_label_horizon_and_split(spark):
    active = spark.createDataFrame([(1,)], "resumeid long").withColumn("date", day("2024-01-10"))
    assert sorted(str(r.date) for r in L.label_horizon(active).collect()) == ["2024-01-07", "2024-01-08", "2024-01-09"]
    for exclusive, want in ((False, (1, 1)), (True, (0, 1))):
        train, test = L.date_split(active, "2024-01-10", exclusive)
        assert (train.count(), test.count()) == want


def histories(spark, *rows):
    days = max(map(len, rows))
    dates = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add(day("2024-01-01"), k))
    return spark.createDataFrame([(k, [5 * x for x in r], [0] * len(r)) for k, r in enumerate(rows)], "resumeid long, clicks array<int>, deliveries array<int>").withColumn("dates", dates)


def hist(df):
    return sorted((r.length, r.n) for r in df.collect())


def test_activity_folds(spark):
    assert hist(H.continuous_runs(histories(spark, [1, 1, 0, 1, 0, 0, 1]))) == [(4, 1)]
    assert hist(H.power_sessions(histories(spark, [1, 1, 0, 0, 0, 1]))) == [(1, 1), (2, 1)]
    assert hist(H.activity_spans(histories(spark, [0, 1, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0]))) == [(3, 1)]
    assert hist(H.active_day_histogram(histories(spark, [0, 1, 0, 0, 1, 0], [0] * 6))) == [(0, 1), (2, 1)]
    assert tuple(H.returns_after_pause(histories(spark, [1, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 0])).first()) == (5, 7)


def test_history_features_pad_with_zeros(spark):
    rows = H.history_features(histories(spark, [1, 0, 0, 0, 0, 0, 1])).orderBy("i").collect()
    assert rows[0].history == [0] * 8 + [5, 0] and rows[0].history_active
    assert rows[5].history == [0] * 10 and not rows[5].history_active
    assert H.training_windows(histories(spark, [1] * 20)).count() == 8
    assert H.training_windows(histories(spark, [1] * 20), test=True).count() == 5


def test_measures(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 3
    d = spark.createDataFrame(rows, "label int, prediction int").withColumn("date", day("2024-01-01"))
    assert E.auc_by_date(d).first().auc == 0.75
    none = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int").withColumn("date", day("2024-01-01"))
    row = E.precision_recall_by_date(none).first()
    assert (row.precision, row.recall, row.f1) == (None, None, None)
    both = E.evaluate(d).first()
    assert (both.tp, both.fp, both.tn, both.fn) == (3, 1, 3, 1)


def test_sampling(spark):
    rows = spark.createDataFrame([(k, float(k % 5 == 0)) for k in range(500)], "id long, label double")
    under = E.undersample(rows, ["id"])
    assert under.filter("label = 1").count() == 100 and 70 < under.filter("label = 0").count() < 130
    assert E.undersample(rows, ["id"]).exceptAll(under).count() == 0
    assert E.oversample(rows).filter("label = 1").count() == 400
    assert E.class_weights(rows).groupBy("label").agg(F.sum("weight").alias("w")).select(F.round("w", 6)).distinct().count() == 1
    assert E.undersample(rows.filter("label = 1"), ["id"]).count() == 100


def test_paths_and_neighbours(spark):
    weights = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "resumeid long, positionid long, weight long")
    got = {r.node: r.log_paths for r in G.path_counts(weights, 1).select("node", F.round(F.exp("log_paths"), 6).alias("log_paths")).collect()}
    assert got == {"p1": 13.0, "r1": 10.0, "r2": 15.0}
    points = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)], "id long, v array<double>")
    near = G.nearest(points, 3, block=16).collect()
    assert len(near) == 150 and all(r.neighbour == r.id for r in near if r["rank"] == 1)
