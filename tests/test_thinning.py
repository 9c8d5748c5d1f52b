"""Thinned series against plain lists."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import thinning as N

T0 = dt.datetime(2024, 1, 1)
SERIES = {"long": 613, "exact": 60, "one": 1, "short": 59, "over": 61}


def frame(spark):
    rows = [(s, T0 + dt.timedelta(minutes=37 * k), float(k * k % 97)) for s, n in SERIES.items() for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").repartition(5)


@pytest.mark.parametrize("width", [1, 7, 60])
def test_strides_and_bucket_means(spark, width):
    df = frame(spark)
    got = {}
    for r in N.strided(df, "symbol", "ts", F.to_date("ts"), width).orderBy("ts").collect():
        got.setdefault(r.symbol, []).append(r.place)
    means = {}
    for r in N.bucket_means(df, "symbol", "ts", "x", F.to_date("ts"), width).orderBy("bucket").collect():
        means.setdefault(r.symbol, []).append((r.bucket, r.ts, r.x, r.n))
    for s, n in SERIES.items():
        step = -(-n // width)
        assert got[s] == list(range((n - 1) % step, n, step)) and len(got[s]) <= width and got[s][-1] == n - 1
        wide, want = min(n, width), []
        for b in range(wide):
            own = range(b * n // wide, (b + 1) * n // wide)
            want.append((b, T0 + dt.timedelta(minutes=37 * own[-1]), pytest.approx(sum(k * k % 97 for k in own) / len(own)), len(own)))
        assert means[s] == want


def test_an_empty_series_has_no_points(spark):
    df = frame(spark).limit(0)
    assert N.strided(df, "symbol", "ts", F.to_date("ts")).count() == N.bucket_means(df, "symbol", "ts", "x", F.to_date("ts")).count() == 0
