"""Streams with state by symbol: restarts, late bars, idle symbols, forming bars and side streams."""

import datetime as dt
import math

import pytest

from barloom.operators import kernels as K
from barloom.streaming import keyed, live

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(hours=h), x, x + 1, x - 1, x, 10.0) for s, h, x in rows], BARS)


def series(symbol, hours):
    return [(symbol, h, 50 + 10 * math.sin(h * 1.7) + (hash(symbol) % 3 if symbol == "x" else 0)) for h in hours]


def ema(stream, begun=None):
    return keyed.stepped(stream, live.ema_start, lambda s, v: live.ema_step(s, v[0], 3), ["close"], "n long, v double", "ema double", begun)


def slow_ema(rows):
    out, held = {}, {}
    for s, h, x in sorted(rows):
        held[s], made = live.ema_step(held.get(s, live.ema_start()), x, 3)
        out[s, T0 + dt.timedelta(hours=h)] = round(made["ema"], 9)
    return out


def test_a_warm_stream_restarts_from_its_checkpoint(spark):
    """State from a batch, a run over some bars, another run from the checkpoint: as one pass over all of them."""
    older, middle, newest = (series("a", r) + series("b", r) for r in (range(8), range(8, 13), range(13, 20)))
    newest += series("new", range(3))
    begun = spark.createDataFrame([(s, T0 + dt.timedelta(hours=7), 8, slow_ema(older)[s, T0 + dt.timedelta(hours=7)]) for s in ("a", "b")], "symbol string, _last timestamp_ntz, n long, v double")
    base = live.new_base(spark)
    for k, rows in enumerate((middle, newest)):
        bars(spark, rows).write.mode("append").parquet(f"{base}/in")
        live.run_once(ema(live.source(spark, bars(spark, []).schema, f"{base}/in"), begun), base)
        assert spark.read.parquet(f"{base}/out").count() == len(middle) + k * len(newest)
    got = {(r.symbol, r.ts): round(r.ema, 9) for r in spark.read.parquet(f"{base}/out").collect()}
    want = slow_ema(older + middle + newest)
    assert got == pytest.approx({k: want[k] for k in got}, abs=1e-8) and len(got) == len(middle + newest)


def test_late_bars_are_those_that_their_own_symbol_has_passed(spark):
    parts = [bars(spark, [("a", 0, 1.0), ("a", 5, 2.0), ("b", 1, 1.0)]), bars(spark, [("a", 3, 9.0), ("a", 5, 9.0), ("b", 3, 2.0), ("a", 6, 3.0)])]
    got = live.replayed({"s": parts}, lambda s: ema(s)).collect()
    late = sorted((r.symbol, r.ts.hour, r.ema) for r in got if r.late)
    assert late == [("a", 3, None), ("a", 5, None)]
    assert {(r.symbol, r.ts.hour) for r in got if not r.late} == {("a", 0), ("a", 5), ("a", 6), ("b", 1), ("b", 3)}
    assert next(r.ema for r in got if r.symbol == "a" and r.ts.hour == 6) == 2.0  # the late ones changed nothing


def test_rings_reach_over_batches(spark):
    rows = series("a", range(9)) + series("b", range(0, 18, 2))
    parts = [bars(spark, rows[k::3]) if k < 0 else bars(spark, [r for r in rows if r[1] // 6 == k]) for k in range(3)]
    got = live.replayed({"s": parts}, lambda s: keyed.rolling(s, 4)).collect()
    assert len(got) == len(rows) and not any(r.late for r in got)
    for r in got:
        own = [x for s, h, x in sorted(rows) if s == r.symbol and T0 + dt.timedelta(hours=h) <= r.ts][-4:]
        mean = sum(own) / len(own)
        std = math.sqrt(sum((x - mean) ** 2 for x in own) / (len(own) - 1)) if len(own) > 1 else 0.0
        assert (r.n, r.high, r.low) == (len(own), max(own), min(own)) and abs(r["mean"] - mean) < 1e-9 and abs(r["std"] - std) < 1e-9


def test_idle_symbols_are_forgotten(spark):
    import time

    base = live.new_base(spark)
    for rows in (series("a", range(4)), series("a", range(4, 6))):
        bars(spark, rows).write.mode("append").parquet(f"{base}/in")
        live.run_once(keyed.rolling(live.source(spark, bars(spark, []).schema, f"{base}/in"), 10, idle_ms=500), base, idle_batches=False)
        time.sleep(1)
    got = sorted((r.ts.hour, r.n) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 1), (5, 2)]


def test_extremes_by_deque():
    import random

    rng = random.Random(4)
    xs = [rng.randrange(9) for _ in range(300)]
    for n in (1, 2, 7):
        top, bottom = keyed.Extreme(n), keyed.Extreme(n, -1)
        for k, x in enumerate(xs):
            own = xs[max(0, k - n + 1) : k + 1]
            assert (top.push(x), bottom.push(x)) == (max(own), min(own))
            assert len(top.kept) <= n


def test_forming_bars_are_replaced_and_replayed_batches_change_nothing(spark):
    from pyspark.sql import functions as F

    rows = series("a", range(11)) + series("b", range(6))
    bucket = F.window("ts", "4 hours").getField("start")
    parts = [bars(spark, [r for r in rows if r[1] // 3 == k]) for k in range(4)]
    kept = []

    def sink(path):
        kept.append(path)
        return keyed.upsert_into(path)

    made = live.replayed({"s": parts}, lambda s: keyed.forming(s, bucket), "update", sink)
    got = {(r.symbol, r.ts.hour): r for r in keyed.with_forming(keyed.upserted(made, ["symbol", "ts"])).collect()}
    assert {k: r.forming for k, r in got.items()} == {("a", 0): False, ("a", 4): False, ("a", 8): True, ("b", 0): False, ("b", 4): True}
    for (s, h), r in got.items():
        own = [x for t, k, x in sorted(rows) if t == s and h <= k < h + 4]
        assert (r.open, r.high, r.low, r.close, r.volume) == (own[0], max(own) + 1, min(own) - 1, own[-1], 10.0 * len(own))
    before = sorted(map(tuple, keyed.upserted(made, ["symbol", "ts"]).collect()))
    again = spark.createDataFrame(spark.read.parquet(f"{kept[0]}/batch=1").collect(), made.drop("batch").schema)
    keyed.upsert_into(kept[0])(again, 1)
    assert sorted(map(tuple, keyed.upserted(spark.read.schema(made.schema).parquet(kept[0]), ["symbol", "ts"]).collect())) == before


def test_side_rows_missing_or_late_leave_nulls(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    left, right = "symbol string, ts timestamp, close double", "symbol string, ts timestamp, rate double"
    one = lambda rows, kind: spark.createDataFrame([(s, at(h), x) for s, h, x in rows], kind)
    far = 10_000
    parts = {
        "bars": [one([("a", 1, 1.0), ("a", 9, 2.0), ("b", 1, 3.0)], left), one([("a", 17, 4.0), ("~", far, 0.0)], left), one([], left)],
        "side": [one([("a", 0, 0.1), ("a", 1, 0.2)], right), one([("b", 8, 0.3), ("~", far, 0.0)], right), one([("a", 16, 0.4), ("b", 0, 0.5)], right)],
    }
    got = live.replayed(parts, lambda bars, side: keyed.side_joined(bars, side, ["rate"], "8 HOURS")).where("symbol <> '~'").collect()
    rows = sorted(((r.symbol, r.close, r.rate) for r in got), key=repr)
    assert rows == sorted([("a", 1.0, 0.1), ("a", 1.0, 0.2), ("a", 2.0, None), ("a", 4.0, None), ("b", 3.0, None)], key=repr)


def test_a_kernel_steps_the_same_in_a_stream(spark):
    rows = series("a", range(40))
    state = "n long, sar double, ep double, af double, long boolean, h1 double, l1 double, h2 double, l2 double"
    parts = [bars(spark, [r for r in rows if r[1] // 20 == k]) for k in range(2)]
    got = live.replayed({"s": parts}, lambda s: keyed.stepped(s, K.sar_start, lambda a, v: K.sar_step(a, *v), ["high", "low"], state, "sar double, is_long boolean, flipped boolean")).orderBy("ts").collect()
    _, want = K.iterate(lambda a, v: K.sar_step(a, *v), K.sar_start(), [(x + 1, x - 1) for _, _, x in rows])
    assert [(r.sar, r.is_long, r.flipped) for r in got] == [tuple(x.values()) for x in want]
