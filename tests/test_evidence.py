"""The checklist, its verdict and the agents over a whole table, against plain functions of each bar's evidence."""

import math
from collections import defaultdict

import pytest

from barloom.operators import multiframe as M
from barloom.operators import routing as R
from barloom.plans import catalog
from barloom.plans.q_patterns import study

INF = float("inf")


@pytest.fixture(scope="module")
def tables(spark, sf):
    return study(spark, sf)


@pytest.fixture(scope="module")
def evidence(tables):
    return {(r.symbol, r.ts): r for r in tables["evidence"].collect()}


@pytest.fixture(scope="module")
def living(tables):
    out = defaultdict(list)
    for r in tables["living"].collect():
        out[r.symbol, r.ts].append(r)
    return out


def sign(x):
    return (x > 0) - (x < 0)


def slow_items(e, patterns, families):
    """number -> (weight, bias, confidence, answered) of those items that have a source."""
    trend = {"up": 1, "down": -1}.get(e.direction, 0)
    rooms = [INF if x is None else x for x in (e.headroom_up, e.headroom_down)]
    leg = 1 if e.leg_up else -1
    back = 0 if e.retraced is None else leg if e.retraced < 0 or 0.38 <= e.retraced <= 0.62 else -leg if e.retraced > 0.66 else 0
    of = {k: [p for p in patterns if (p.pattern in families) == (k == "reversal")] for k in ("reversal", "continuation")}

    def shapes(some):
        mass = sum(p.significance for p in some)
        return sign(sum(p.significance * p.bias for p in some)), min(1.0, mass / max(1, len(some))), bool(some)

    return {
        1: (2.5, e.permitted, min(1.0, 2 * abs(e.alignment)) if e.permitted else 0.5, e.ready),
        3: (1.5, e.permitted, 1.0, e.n_direction > 0),
        4: (2.5, trend, e.trend_confidence, e.pivots_used >= 2),
        5: (1.5, sign(rooms[0] - rooms[1]) if rooms[0] != rooms[1] else 0, 1.0, e.n_levels > 0),
        6: (1.5, e.line_bias or 0, 1.0, e.n_lines > 0),
        7: (1.5, trend if e.volume_ratio >= 1.3 and trend else -1 if e.volume_ratio < 0.7 and trend > 0 else 0, 1.0, True),
        8: (1.5, back, 1.0, e.retraced is not None),
        9: (1.0, e.gap_bias or 0, 1.0, True),
        10: (2.0, *shapes(of["reversal"])),
        11: (1.5, *shapes(of["continuation"])),
        12: (0.0, 0, 1.0, bool(patterns)),
        13: (2.0, e.ma_bias, 1.0, e.n >= 50),
        14: (1.0, -1 if e.rsi >= 70 else 1 if e.rsi <= 30 else 0, 1.0, e.n >= 15),
        15: (2.0, sign((e.bullish_divergences or 0) - (e.bearish_divergences or 0)), 1.0, True),
        17: (1.5, e.ell.bias if e.ell else 0, e.ell.confidence if e.ell else 0.0, e.ell is not None),
        18: (0.0, 0, 1.0, e.ell is not None),
        19: (0.0, 0, 1.0, e.ell is not None),
        22: (2.0, sign(e.plus_di - e.minus_di) if e.adx > 20 and abs(e.plus_di - e.minus_di) > 1e-9 else 0, min(1.0, e.adx / 40) if e.n >= 29 else 0.0, e.n >= 29),
        23: (1.0, sign(e.candle_bias), 1.0, e.has_candle),
    }


def slow_verdict(e, items):
    answered = [(w * c, b) for w, b, c, a in items.values() if a]
    total = sum(w for w, _ in answered)
    score = sum(w * b for w, b in answered) / total if total > 0 else 0.0
    bull, bear = (sum(w for w, b in answered if b == side) for side in (1, -1))
    agreement = abs(bull - bear) / (bull + bear) if bull + bear > 0 else 0.0
    coverage = len(answered) / 23
    bias = sign(score) if abs(score) >= 0.12 else 0
    blockers = [x for x, on in (("not ready", not e.ready), ("coverage", coverage < 0.55), ("higher timeframe", bias and e.permitted != bias)) if on]
    return {"score": score, "bias": bias, "agreement": agreement, "coverage": coverage, "conviction": min(1.0, abs(score) * (0.4 + 0.6 * coverage) * (0.5 + 0.5 * agreement)), "blockers": blockers}


@pytest.fixture(scope="module")
def slow(evidence, living):
    from barloom.operators.patterns import KINDS

    families = {k for k, (_, reversal) in KINDS.items() if reversal}
    items = {k: slow_items(e, living.get(k, []), families) for k, e in evidence.items()}
    return items, {k: slow_verdict(evidence[k], items[k]) for k in evidence}


def test_every_item_of_every_bar(tables, slow):
    got = M.checklist(tables["evidence"]).collect()
    items = slow[0]
    assert len(got) == 23 * len(items)
    for r in got:
        want = items[r.symbol, r.ts].get(r.number)
        if want is None:
            assert r.status == "unavailable" and r.number in M.UNAVAILABLE
            continue
        weight, bias, confidence, answered = want
        assert (r.weight, r.status) == (weight, "answered" if answered else "not_ready"), r
        if answered:
            assert r.bias == bias and r.confidence == pytest.approx(confidence), r
    assert {r.number for r in got if r.status == "answered" and r.bias} >= {4, 5, 6, 8, 13, 15, 22, 23}


def test_every_verdict(tables, slow):
    e = tables["evidence"]
    got = M.verdict(M.checklist(e), e.select("symbol", "ts", "ready", "permitted")).collect()
    assert len(got) == len(slow[1])
    for r in got:
        want = slow[1][r.symbol, r.ts]
        assert (r.bias, list(r.blockers)) == (want["bias"], want["blockers"])
        for k in ("score", "agreement", "coverage", "conviction"):
            assert r[k] == pytest.approx(want[k], abs=1e-9), k


def slow_structure(e, v):
    out = {}
    trend = {"up": 1, "down": -1}.get(e.direction, 0)
    if not v["blockers"] and v["bias"] and v["coverage"] >= 0.55 and v["conviction"] >= 0.2:
        out["checklist"] = v["score"], min(1.0, 0.35 + 0.65 * v["agreement"]), 48
    if not e.ready:
        return out
    room = e.headroom_up if trend > 0 else e.headroom_down
    along = e.leg_up is not None and e.leg_up == (trend > 0)
    if trend and e.permitted == trend and e.health in ("intact", "confirmed") and (room is None or room >= 1.5) and (e.fan or 0) < 3 and not (along and e.retraced > 0.66) and not (e.dmi_ready and e.adx < 20):
        touches = e.uptrend_touches if trend > 0 else e.downtrend_touches
        bonus = (min(0.25, 0.08 * touches) if touches else 0.0) + ((0.25 if 0.4 <= e.retraced <= 0.6 else 0.1) if along and 0 <= e.retraced <= 0.66 else 0.0)
        sure = min(1.0, max(0.0, e.trend_confidence * (0.4 + 0.6 * min(1.0, (e.adx - 20) / 20) if e.dmi_ready else 0.4)))
        if sure > 0.05:
            out["structure"] = trend * min(1.0, 0.45 + bonus), sure, 36
    up, down = e.bullish_divergences or 0, e.bearish_divergences or 0
    side, n = (1, up) if up > down else (-1, down)
    if n >= 2 and trend == -side and (e.rsi >= 60 if side < 0 else e.rsi <= 40):
        out["divergence"] = side * 0.5, min(0.7, 0.25 + 0.15 * n), 18
    return out


def same(got, want):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        score, confidence, horizon = want[r.symbol, r.ts][r.agent]
        assert (r.score, r.confidence, r.horizon) == (pytest.approx(score, abs=1e-9), pytest.approx(confidence, abs=1e-9), horizon), r


def test_structure_agents(tables, evidence, slow):
    e = tables["evidence"]
    v = M.verdict(M.checklist(e), e.select("symbol", "ts", "ready", "permitted")).selectExpr("symbol", "ts", "bias", "score", "agreement", "conviction", "coverage", "size(blockers) AS n_blockers")
    got = R.structure_signals(v.join(e, ["symbol", "ts"])).collect()
    same(got, {k: slow_structure(evidence[k], slow[1][k]) for k in evidence})


def test_formation_agents(tables, evidence, living):
    bars = defaultdict(list)
    for symbol, ts in sorted(evidence):
        bars[symbol].append(ts)
    place = {(s, t): i for s, ts in bars.items() for i, t in enumerate(ts)}
    candles = defaultdict(list)
    for r in tables["signals"].collect():
        if r.bias and r.strength >= 0.55 and r.sessions >= 2:
            candles[r.symbol, place[r.symbol, r.ts]].append(r)
    want = {}
    for (symbol, ts), e in evidence.items():
        out = want[symbol, ts] = {}
        if not e.ready:
            continue
        fresh = []
        for p in living.get((symbol, ts), []):
            reward = abs(p.objective - p.broke_at) / abs(p.broke_at - p.stop) if min(p.objective, p.broke_at, p.stop) > 0 and p.broke_at != p.stop else 0.0
            met = p.objective > 0 and (p.high >= p.objective if p.bias > 0 else p.low <= p.objective)
            if p.significance >= 0.35 and reward >= 3 and p.volume_ratio >= (1.2 if p.bias > 0 else 0.8) and p.i - p.breakout_index <= 20 and not met:
                fresh.append(p)
        if fresh:
            best = max(fresh, key=lambda p: (p.significance, p.detected_index, p.id))
            total = sum(p.significance for p in fresh)
            net = sum(p.significance * (1 if p.bias == best.bias else -1) for p in fresh) / total
            sure = min(1.0, best.significance * net + (0.1 if best.stage == "return_move" else 0.0))
            if best.bias == e.permitted and net > 0 and sure >= 0.1:
                out["patterns"] = best.bias * min(1.0, 0.5 + 0.5 * net), sure, max(12, best.end_index - best.first_index)
        i = place[symbol, ts]
        recent = [c for k in range(max(0, i - 3), i + 1) for c in candles[symbol, k]]
        if recent:
            top = max((c.strength, c.sessions) for c in recent)
            sides = {c.bias for c in recent if (c.strength, c.sessions) == top}
            if len(sides) == 1 and e.permitted in sides and e.atr > 0 and e.nearest is not None and abs(e.close - e.nearest) <= e.atr:
                out["candles"] = e.permitted * min(1.0, 0.4 + 0.4 * top[0]), min(1.0, top[0] * (0.7 + 0.1 * top[1])), 8
            elif len(sides) > 1:
                out["either"] = math.nan, math.nan, 0
        if e.ell and e.ell.bias and e.ell.n_violations == 0 and e.ell.confidence >= 0.6 and e.permitted == e.ell.bias:
            out["waves"] = 0.5 * e.ell.bias, min(1.0, 0.8 * e.ell.confidence), 60
    assert not any("either" in x for x in want.values())
    e = tables["evidence"]
    waves = e.selectExpr("symbol", "ts", "ell.bias AS bias", "ell.confidence AS confidence", "ell.n_violations AS n_violations")
    same(R.formation_signals(e, tables["living"], tables["signals"], waves).collect(), want)


def test_the_queries_give_the_same(spark, sf, slow):
    got = catalog.queries()["verdict"](spark, sf).collect()
    assert sorted((r.symbol, r.ts, r.bias, r.blockers) for r in got) == sorted((*k, v["bias"], ",".join(v["blockers"])) for k, v in slow[1].items())
