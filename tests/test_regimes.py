"""The two-state fit: rounds as aggregations against a task's own rounds, and what follows from the states, row by row."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import regimes as Q
from barloom.operators.stats import fit_two_states

T0 = dt.datetime(2024, 1, 1)


def returns(spark):
    rng = np.random.default_rng(5)
    series = {
        "two": np.where(np.arange(400) // 50 % 2, rng.normal(0.01, 0.05, 400), rng.normal(0, 0.005, 400)),
        "wild_end": np.concatenate([rng.normal(0, 0.01, 200), rng.normal(0, 0.2, 60)]),
        "short": rng.normal(0, 0.01, 12),
        "zeros": np.concatenate([np.zeros(50), rng.normal(0, 0.01, 40), rng.normal(0, 0.1, 20)]),
    }
    rows = [(s, T0 + dt.timedelta(hours=k), float(v)) for s, x in series.items() for k, v in enumerate(x)]
    rows += [("two", T0 - dt.timedelta(hours=1), None), ("two", T0 - dt.timedelta(hours=2), float("nan")), ("none", T0, 0.0)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double").repartition(3), series


def test_rounds_of_aggregations_equal_those_of_a_task(spark):
    df, series = returns(spark)
    own, rounds = ({r.symbol: r for r in Q.fit_regimes(df, "symbol", local=n)[0].collect()} for n in (10**6, 0))
    assert set(own) == set(rounds) == set(series)
    for s in series:
        assert (own[s].n, own[s].converged) == (rounds[s].n, rounds[s].converged) == (int((series[s] != 0).sum()), s != "short")
        for c in ("m0", "v0", "m1", "v1"):
            assert rounds[s][c] == pytest.approx(own[s][c], rel=1e-4, abs=1e-7)


def test_states_and_risk_row_by_row(spark):
    df, series = returns(spark)
    states = Q.regime_states(df, "symbol", "ts")
    got = {}
    for r in states.orderBy("ts").collect():
        got.setdefault(r.symbol, []).append(r)
    risk = {r.symbol: r for r in Q.regime_risk(states, "symbol", "ts").collect()}
    assert set(risk) == set(series)
    for s, x in series.items():
        fit = fit_two_states(x[x != 0])
        assert [r.state for r in got[s]] == fit["states"].tolist()
        seq = fit["states"].tolist()
        now = int(fit["last"] > 0.5)
        after = [b for a, b in zip(seq, seq[1:]) if a == now]
        ratio = min(50, fit["std"][1] / fit["std"][0])
        r = risk[s]
        assert r.label == ("turbulent" if now else "calm") and r.prob_turbulent == pytest.approx(fit["last"], abs=1e-3)  # the loop gives shares under the parameters before the last round
        assert r.persistence == pytest.approx(1.0 if s == "short" else after.count(now) / len(after) if after else 0.0)
        assert r.vol_ratio == pytest.approx(ratio) and not r.degenerate
        assert r.risk_scalar == pytest.approx(max(0.35, 1 / max(1, ratio)) if now else 1.0)
    assert {r.label for r in risk.values()} == {"calm", "turbulent"}


def test_a_collapsed_state_is_degenerate_and_its_ratio_capped(spark):
    rows = [("a", T0, 0.0, 0, 0.0, 0.001, 0.0, 0.2, 40, True), ("b", T0, 0.9, 1, 0.0, 0.0, 0.0, 0.2, 40, True), ("c", T0, 0.9, 1, 0.0, 0.1, 0.0, 0.15, 40, True)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, prob_turbulent double, state int, calm_mean double, calm_std double, turbulent_mean double, turbulent_std double, n long, converged boolean")
    got = {r.symbol: (r.vol_ratio, r.degenerate, round(r.risk_scalar, 6), r.persistence) for r in Q.regime_risk(df, "symbol", "ts").collect()}
    assert got == {"a": (50.0, True, 1.0, 0.0), "b": (1.0, True, 1.0, 0.0), "c": (pytest.approx(1.5), False, round(1 / 1.5, 6), 0.0)}


# --- resampling ---


def _draw(*keys):
    import hashlib

    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 2**52


def test_draws_hang_on_their_keys_alone(spark):
    from pyspark.sql import functions as F

    from barloom.operators import stats as S

    df = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 3).alias("k"), "id")
    for parts in (1, 5):
        got = {r.id: r.u for r in df.repartition(parts).select("id", S.draw(F.lit(7), "k", F.lit(3), "id").alias("u")).collect()}
        assert got == {i: _draw(7, f"s{i % 3}", 3, i) for i in range(40)}
    cuts = S.poisson_cuts()
    assert sum(1 - c for c in cuts) == pytest.approx(1.0, abs=1e-9) and cuts[0] == pytest.approx(np.exp(-1))


def test_resampled_tests_against_plain_loops(spark):
    from barloom.operators import stats as S

    rng = np.random.default_rng(2)
    x = {"a": rng.normal(0.05, 1, 40), "b": rng.normal(0.4, 1, 25), "few": rng.normal(0, 1, 6)}
    held = {s: (np.arange(len(v)) % 3 == 0).astype(float) for s, v in x.items()}
    at = lambda k: T0 + dt.timedelta(hours=k)
    micros = lambda k: int((at(k) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    rows = [(s, at(k), float(v), float(held[s][k] * v)) for s, vs in x.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double, strategy double").repartition(4)
    boot = {r.symbol: r for r in S.bootstrap_sharpe(df, "symbol", "ts", "ret", 100.0, resamples=60).collect()}
    perm = {r.symbol: r for r in S.permutation_test(df, "symbol", "ts", "strategy", "ret", resamples=60).collect()}
    assert (boot["few"].statistic, boot["few"].p_value, boot["few"].resamples) == (0.0, 1.0, 0) == (perm["few"].statistic, perm["few"].p_value, perm["few"].resamples)
    for s in ("a", "b"):
        d, e = [], []
        for r in range(60):
            u = np.array([_draw(7, s, r, micros(k)) for k in range(len(x[s]))])
            v = np.repeat(x[s], [sum(w >= c for c in S.poisson_cuts()) for w in u])
            d.append(v.mean() / v.std(ddof=1) * 10)
            e.append((held[s][np.argsort(u, kind="stable")] * x[s]).sum())
        for got, draws, p in ((boot[s], d, np.mean(np.array(d) <= 0)), (perm[s], e, np.mean(np.array(e) >= (held[s] * x[s]).sum()))):
            assert (got.lower, got.upper) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=1e-9) and got.p_value == pytest.approx(p) and got.resamples == 60
        assert boot[s].statistic == pytest.approx(x[s].mean() / x[s].std(ddof=1) * 10) and perm[s].statistic == pytest.approx((held[s] * x[s]).sum())
