"""Chart patterns from pivots laid out by hand, their life, gaps and the checklist."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators import kernels as K
from barloom.operators import multiframe as M
from barloom.operators import patterns as P
from barloom.operators import structure as S
from tests.test_operators import bars, walk

PIVOT = "symbol string, ts timestamp_ntz, index int, price double, kind string, confirmed_index int, volume double, confirm_atr double"


def pivots(spark, prices, every=12, first="trough"):
    kinds = [first, "peak" if first == "trough" else "trough"]
    rows = [("TEST", dt.datetime(2024, 1, 1), i * every, float(p), kinds[i % 2], i * every + 3, 1000.0, 1.5) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, PIVOT)


def path_bars(spark, prices, every=12, tail=30, atr=2.0, way=0):
    """Bars that go straight from pivot to pivot."""
    path = [a + (b - a) * k / every for a, b in zip(prices, prices[1:]) for k in range(every)] + [float(prices[-1])] * tail
    return bars(spark, path).withColumns({"atr": F.lit(atr), "way": F.lit(way)})


def kinds(spark, prices, way=0, **kw):
    b = path_bars(spark, prices, kw.get("every", 12), way=way)
    return {(r.pattern, r.bias): r for r in P.recognise(pivots(spark, prices, **kw), b, trend="way").orderBy("found_index").collect()}


def test_head_and_shoulders(spark):
    got = kinds(spark, [100, 120, 108, 135, 110, 121])
    r = got["head_shoulders_top", -1]
    assert r.stop == 121 and r.height == pytest.approx(135 - 109) and r.detected_index == 63
    mirrored = kinds(spark, [200 - x for x in (100, 120, 108, 135, 110, 121)], first="peak")
    assert ("head_shoulders_bottom", 1) in mirrored


def test_double_top_needs_time(spark):
    got = kinds(spark, [100, 130, 112, 129])
    assert got["double_top", -1].boundary == 112 and got["double_top", -1].height == 18 and got["double_top", -1].worst == 130
    assert ("double_top", -1) not in kinds(spark, [100, 130, 112, 129], every=6)


SHAPES = {
    "triple_top": ([100, 130, 112, 129, 111, 130], -1, 0),
    "double_top": ([100, 130, 112, 129], -1, 0),
    "measured_move_up": ([100, 130, 118], 1, 0),
    "rounding_bottom": ([110, 116, 104, 110, 102, 109, 104, 112, 110], 1, 0),
    "rectangle": ([100, 120, 100.5, 120.5, 100, 120], 1, 1),
    "symmetrical_triangle": ([112, 150, 120, 144, 126, 138], -1, -1),
    "ascending_triangle": ([112, 150, 120, 150, 128, 150], 1, 0),
    "rising_wedge": ([100, 140, 114.4, 147.2, 128.8, 154.4], -1, 0),
    "broadening": ([110, 130, 102, 138, 94, 146], -1, 1),
}
MIRRORS = {"triple_top": "triple_bottom", "double_top": "double_bottom", "measured_move_up": "measured_move_down", "rounding_bottom": "rounding_top", "ascending_triangle": "descending_triangle", "rising_wedge": "falling_wedge", "symmetrical_triangle": "symmetrical_triangle", "rectangle": "rectangle"}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes_and_their_mirrors(spark, name):
    prices, bias, way = SHAPES[name]
    got = kinds(spark, prices, way=way)
    assert (name, bias) in got
    if name in MIRRORS:
        upside_down = kinds(spark, [300 - x for x in prices], way=-way, first="peak")
        a, b = got[name, bias], upside_down[MIRRORS[name], -bias]
        assert (a.height, a.boundary, a.stop, a.slope) == pytest.approx((b.height, 300 - b.boundary, 300 - b.stop, -b.slope))
    else:
        assert (name, bias) not in kinds(spark, prices, way=-way)


def test_without_a_trend_both_ways_are_open(spark):
    got = kinds(spark, SHAPES["symmetrical_triangle"][0])
    up, down = got["symmetrical_triangle", 1], got["symmetrical_triangle", -1]
    assert up.stop == pytest.approx(down.boundary) and up.apex == down.apex > up.end_index


def test_sharp_turns_are_no_arcs(spark):
    prices = [110, 150, 80, 110, 60, 110, 80, 150, 110]
    assert not any(k.startswith("rounding") for k, _ in kinds(spark, prices, every=4))
    early = [106, 116, 102, 110, 103, 109, 105, 112, 110]  # the lowest trough is the second of five
    assert ("rounding_bottom", 1) in kinds(spark, early)


def test_bars_outside_the_lines_end_a_triangle(spark):
    prices = SHAPES["symmetrical_triangle"][0]
    p, b = pivots(spark, prices), path_bars(spark, prices)
    wild = b.withColumn("high", F.when(F.minute("ts") % 25 == 0, F.col("high") + 60).otherwise(F.col("high")))
    assert P.recognise(p, b).where("family = 'lines'").count() == 6 and P.recognise(p, wild).where("family = 'lines'").count() == 0


def life(spark, path, found=None):
    found = found or P.recognise(pivots(spark, [100, 130, 112, 129]), path_bars(spark, [100, 130, 112, 129])).where("pattern = 'double_top'")
    b = bars(spark, path).withColumn("atr", F.lit(2.0))
    return P.lifecycle(found, b).orderBy("at", "id").collect(), b


def test_life_of_a_pattern(spark):
    path = [120.0] * 45 + [110.0, 109.0, 104.0, 111.5, 108.0, 100.0] + [95.0] * 5
    events, b = life(spark, path)
    assert [(r.at, r.stage) for r in events] == [(39, "forming"), (45, "complete"), (48, "return_move"), (49, "resumed")]
    assert events[1].objective == 112 - 18 and events[1].broke_at == 110 and events[1].volume_ratio == 1
    assert [(r.at, r.stage) for r in life(spark, [120.0] * 200)[0]] == [(39, "forming"), (120, "expired")]
    assert [r.stage for r in life(spark, [120.0] * 45 + [105.0, 125.0])[0]] == ["forming", "complete", "failed"]
    assert [r.stage for r in life(spark, [120.0] * 45 + [131.0, 132.0, 100.0])[0]] == ["forming", "expired"]
    # A close under the boundary by less than a hundredth completes nothing.
    assert [r.stage for r in life(spark, [120.0] * 45 + [111.0] * 10)[0]] == ["forming"]
    events = life(spark, path)[0]
    df = spark.createDataFrame(events)
    living = {(r.i, r.stage): r for r in P.live(df, b).collect()}
    assert sorted(living) == [(45, "complete"), (46, "complete"), (47, "complete"), (48, "return_move"), *[(i, "resumed") for i in range(49, 56)]]
    span, core = 36 - 12, None
    core = (0.30 * span / 40 + 0.28 * 1 + 0.14 * (0.65 * 0.5 + 0.35 * (0.4 / 1.4))) / 0.72
    assert living[45, "complete"].significance == pytest.approx(core)
    assert living[50, "resumed"].significance == pytest.approx(core * (0.55 + 0.45 * (1 - 5 / 25)))


def test_a_shape_seen_again_is_not_new():
    book = P.PatternBook()
    base = {k: None for k in P.SHAPE_NAMES} | {"family": "tests", "pattern": "double_top", "bias": -1, "boundary": 90.0, "slope": 0.0, "height": 10.0, "stop": 100.0, "first_index": 1, "end_index": 30, "detected_index": 33, "worst": 100.0}
    assert len(book.born(33, base | {"points": [1, 15, 30]})) == 1
    assert book.born(40, base | {"points": [15, 30, 38]}) == [] and len(book.born(40, base | {"points": [30, 38, 60]})) == 1
    assert len(book.born(40, base | {"points": [1, 15, 30], "bias": 1})) == 1
    for k in range(5):
        assert len(book.born(50 + k, base | {"points": [100 * k + 100, 100 * k + 110, 100 * k + 120], "detected_index": 50 + k})) == 1
    out = book.born(60, base | {"points": [900, 910, 920], "detected_index": 60})
    assert [e[2] for e in out] == ["forming", "dropped"] and out[1][1] == 33 and len(book.live["tests"]) == 8


def test_volumes():
    v = P.Volumes(mean_of=4)
    for x in (1, 1, 1, 1, 1, 1, 3, 3, 3, 9):
        v.add(float(x))
    assert v.ratio() == 9 / 4.5 and v.dried(0, 5) == 1 and v.dried(3, 8) == 3 and v.dried(5, 8) == 1


def test_flag_after_a_pole(spark):
    path = [100.0] * 30 + [100 + 5 * i for i in range(1, 13)] + [158, 156, 157, 155, 156, 155, 156]
    b = I.atr(bars(spark, [float(x) for x in path], spread=0.3))
    got = P.flags(b).collect()
    assert got and all(r.pattern in ("flag", "pennant") and r.bias == 1 and r.boundary > r.stop and r.objective == pytest.approx(r.boundary + r.height) for r in got)
    rows = b.orderBy("ts").collect()
    for r in got:  # first close to last close of the pole, over what its bars travelled
        pole = rows[r.first_index : r.first_index + 12]
        assert r.height == pytest.approx(pole[-1].close - pole[0].close) and r.height >= 0.55 * sum(x.high - x.low for x in pole)
    choppy = [100.0] * 30 + [x for i in range(6) for x in (100 + 10 * i + 12, 100 + 10 * i + 4)] + [154.0] * 8
    assert not any(r.first_index >= 30 for r in P.flags(I.atr(bars(spark, choppy))).collect())


def test_spikes_stand_far_from_their_pivot(spark):
    path = [100.0 + 2 * k for k in range(30)] + [150.0]
    b = bars(spark, path).withColumn("atr", F.lit(2.0)).withColumn("high", F.when(F.col("close") == 150, 170.0).otherwise(F.col("high")))
    p = spark.createDataFrame([("TEST", dt.datetime(2024, 1, 1, 0, 15), 2, 100.0, "trough", 3, 1.0, 1.0)], PIVOT)
    [r] = P.spikes(b, S.extremes_since_pivot(b, p), p).collect()
    assert (r.pattern, r.bias, r.boundary, r.height, r.objective, r.stop) == ("spike_top", -1, 150.0, 25.0, 125.0, 170.0)


def test_gaps_fill_once(spark):
    b = bars(spark, [100.0, 100.5, 100.0], spread=0.5).unionByName(bars(spark, [100.0] * 3).limit(0))
    rows = b.orderBy("ts").collect()
    t0 = rows[-1].ts
    more = [("TEST", t0 + dt.timedelta(minutes=5 * k), o, h, lo, c, 1000.0) for k, (o, h, lo, c) in enumerate([(110, 112, 109, 111), (111, 113, 110, 112), (112, 112, 99, 100), (100, 101, 90, 95)], 1)]
    df = b.unionByName(spark.createDataFrame([(s, t, float(o), float(h), float(lo), float(c), v) for s, t, o, h, lo, c, v in more], b.schema)).withColumn("atr", F.lit(2.0))
    g = S.gaps(df).collect()
    assert [(r.up, r.gap_high, r.filled_at, r.closed_through_at) for r in g if r.up] == [(True, 109.0, 5, 5 if 100 < g[0].gap_low else 6)]


def test_checklist_counts_only_answers(spark):
    base = {
        "symbol": "'S'", "ts": "timestamp_ntz'2024-01-01'", "ready": "true", "permitted": "1", "alignment": "0.8D", "n_direction": "2", "direction": "'up'", "trend_confidence": "1.0D", "pivots_used": "8", "headroom_up": "cast(null as double)",
        "headroom_down": "1.0D", "n_levels": "3", "line_bias": "cast(null as int)", "n_lines": "0", "volume_ratio": "1.0D", "retraced": "0.5D", "leg_up": "true", "gap_bias": "cast(null as int)", "reversal_mass": "cast(null as double)", "reversal_net": "cast(null as double)", "reversal_n": "cast(null as long)",
        "continuation_mass": "cast(null as double)", "continuation_net": "cast(null as double)", "continuation_n": "cast(null as long)", "ma_bias": "1", "ma_ready": "true", "rsi": "50D", "rsi_ready": "true", "bullish_divergences": "cast(null as int)", "bearish_divergences": "cast(null as int)",
        "elliott_bias": "cast(null as int)", "elliott_confidence": "cast(null as double)", "plus_di": "30D", "minus_di": "10D", "adx": "40D", "dmi_ready": "true", "candle_bias": "0D", "has_candle": "false",
    }
    row = spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in base.items()])
    items = {r.number: r for r in M.checklist(row).collect()}
    assert len(items) == 23 and all(items[n].status == "unavailable" for n in M.UNAVAILABLE)
    assert [items[n].bias for n in (1, 3, 4, 5, 8, 13, 22)] == [1] * 7 and items[10].status == items[17].status == items[23].status == "not_ready"
    v = M.verdict(M.checklist(row), row.select("symbol", "ts", "ready", "permitted")).first()
    answered = [r for r in items.values() if r.status == "answered"]
    want = sum(r.bias * r.weight * r.confidence for r in answered) / sum(r.weight * r.confidence for r in answered)
    assert v.score == pytest.approx(want) and v.bias == 1 and v.agreement == 1 and v.coverage == pytest.approx(len(answered) / 23)


def test_larger_frames_are_known_late(spark):
    closes = walk(600, 9)
    b = bars(spark, closes).withColumn("ts", (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1))).cast("timestamp_ntz"))
    whole = {r.ts: (r.permitted, r.alignment) for r in M.frame_stack(b).collect()}
    part = {r.ts: (r.permitted, r.alignment) for r in M.frame_stack(b.where("ts < '2024-01-16'")).collect()}
    assert len(part) == 360 and all(whole[t] == v for t, v in part.items())


def test_trend_uses_only_known_pivots(spark):
    b = I.atr(bars(spark, walk(400, 10)))
    whole = {r.ts: (r.direction, r.health) for r in S.dow_trend(b, K.swings(b)).collect()}
    cut = sorted(whole)[250]
    early = I.atr(bars(spark, walk(400, 10)).where(F.col("ts") < F.lit(cut)))
    assert all(whole[r.ts] == (r.direction, r.health) for r in S.dow_trend(early, K.swings(early)).collect())
