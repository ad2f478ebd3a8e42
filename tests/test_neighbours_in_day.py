"""Equal vectors of a day are looked for once, with the same neighbours as row by row."""

import datetime

import numpy as np

from strandline.operators import graph as G


def test_equal_vectors(spark, monkeypatch):
    met, plain = [], G._nearest
    monkeypatch.setattr(G, "_nearest", lambda points, *rest: met.append(points.count()) or plain(points, *rest))
    rng = np.random.default_rng(3)
    rows = [(k, datetime.date(2024, 1, 1 + k % 2), float(rng.integers(3)), float(rng.integers(3))) for k in range(60)]
    df = spark.createDataFrame(rows, "resumeid long, date date, x double, y double")
    got = sorted(tuple(r) for r in G.nearest_in_day(df, ["x", "y"]).select("resumeid", "date", "rank", "neighbour", "distance").collect())
    want = []
    for k, day, x, y in rows:
        near = sorted(((x - c) ** 2 + (y - d) ** 2, n) for n, other, c, d in rows if other == day and n != k)[:3]
        want += [(k, day, rank, n, distance) for rank, (distance, n) in enumerate(near, 1)]
    assert got == sorted(want)
    assert met == [df.select("date", "x", "y").distinct().count()]
