"""Bars against the latest value of every other symbol, by a plain loop over all bars in order."""

import datetime as dt
import random

import pytest

from barloom.operators.cross_section import peers_as_of


def slow(rows):
    latest, out = {}, []
    for ts, symbol, value in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)):
        latest[symbol] = value
        live = {s: round(v, 9) for s, v in latest.items() if v is not None}
        if value is None:
            out.append((ts, symbol, value, None, None, None, None))
            continue
        place = sorted(live, key=lambda s: (live[s], s)).index(symbol)
        out.append((ts, symbol, value, len(live), place, round(max(live.values()) - min(live.values()), 7), round(sum(live.values()) / len(live), 7)))
    return sorted(out, key=repr)


def irregular(seed, symbols, n):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    every = {s: rng.choice([1, 3, 7, 60]) for s in symbols}
    rows = set()
    for _ in range(n):
        s = rng.choice(symbols)
        rows.add((start + dt.timedelta(minutes=every[s] * rng.randrange(1 + 600 // every[s])), s))
    return [(ts, s, rng.choice([None, rng.randrange(-5, 5) / 4, round(rng.gauss(0, 1), 4)])) for ts, s in sorted(rows)]


@pytest.mark.parametrize("rows", [17, 100, 10**6])
def test_slices_do_not_change_what_is_seen(spark, rows):
    bars = irregular(rows, [f"s{k}" for k in range(9)], 700)
    df = spark.createDataFrame(bars, "ts timestamp_ntz, symbol string, value double").repartition(3)
    got = peers_as_of(df, "value", rows=rows)
    assert got.columns == ["ts", "symbol", "value", "peers", "peer_place", "peer_spread", "peer_mean"]
    got = [(r.ts, r.symbol, r.value, r.peers, r.peer_place, None if r.peers is None else round(r.peer_spread, 7), None if r.peers is None else round(r.peer_mean, 7)) for r in got.collect()]
    assert sorted(got, key=repr) == slow(bars)


def test_odd_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "a", 1.0, 5), (t, "b", 1.0, 6), (None, "a", 9.0, 7), (t, None, 9.0, 8), (t, "a", 2.0, 5), (t, "a", None, 5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, m double, slice int")
    got = sorted(((r.symbol, r.m, r.slice, r.peers, r.peer_place) for r in peers_as_of(df, "m", rows=2).collect()), key=repr)
    assert got == sorted([("a", None, 5, None, None), ("a", 1.0, 5, 1, 0), ("a", 2.0, 5, 1, 0), ("b", 1.0, 6, 2, 0)], key=repr)
    assert peers_as_of(df.limit(0), "m").count() == 0


def test_a_peer_that_is_no_more_ready_goes(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    rows = [(t[0], "a", 1.0), (t[1], "b", 3.0), (t[2], "c", 2.0), (t[3], "b", None), (t[4], "a", 2.5), (t[5], "c", 2.0)]
    got = peers_as_of(spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, m double"), "m", rows=1)
    assert [(r.symbol, r.peers, r.peer_place) for r in got.orderBy("ts").collect()] == [("a", 1, 0), ("b", 2, 1), ("c", 3, 1), ("b", None, None), ("a", 2, 1), ("c", 2, 0)]
