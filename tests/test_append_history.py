"""Histories joined to samples: no resume with samples is made up."""

import datetime as dt

from strandline.operators import history as H
from strandline.plans.queries import QUERIES, Tables


def test_resumes_without_samples_are_made_up(spark):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(12)]
    rows = [(k, dates, [1] * 12, [1] * 12) for k in (3, 4)]
    histories = spark.createDataFrame(rows, "resumeid bigint, dates array<date>, clicks array<bigint>, deliveries array<bigint>")
    samples = spark.createDataFrame([(3, dates[8], 1.0, 5)], "resume_id bigint, date date, label double, click_count bigint")
    got = H.append_history(samples, histories).collect()
    assert [(r.date, r.click_count, r.made_up) for r in got if r.resumeid == 3] == [(dates[8], 5, False)]
    made = [r for r in got if r.resumeid == 4]
    assert made and all(r.made_up and r.click_count == 0 for r in made)


def test_every_resume_with_samples_keeps_them(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    known = {r.resume_id for r in t.labelled().select("resume_id").distinct().collect()}
    got = QUERIES["jn17_append_history"](spark, "/root/testdata/sf0.001").collect()
    assert {r.resumeid for r in got if not r.made_up and r.resumeid % 3 == 0}
    assert not {r.resumeid for r in got if r.made_up} & known
