"""Account guards, target filters, order routing and outside views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import clamp
from barloom.session import ship_package

#: Loss of a day from which only reductions pass, and fall from the peak from which nothing does.
DAY_LOSS, DRAWDOWN = 0.03, 0.15


def guard_start() -> dict:
    return {"day": None, "base": 0.0, "peak": 0.0, "state": "normal"}


def guard_step(s: dict, day: str, equity: float) -> tuple[dict, dict]:
    """The account's state after an equity point: the day's base rolls by the event's day, a halt stays for good."""
    base, state = s["base"], s["state"]
    if day != s["day"]:
        base = equity
        state = "normal" if state == "reduce_only" else state
    peak = max(s["peak"], equity)
    loss = (base - equity) / base if base > 0 else 0.0
    fall = (peak - equity) / peak if peak > 0 else 0.0
    if fall >= DRAWDOWN:
        state = "halted"
    elif loss >= DAY_LOSS and state == "normal":
        state = "reduce_only"
    return {"day": day, "base": base, "peak": peak, "state": state}, {"state": state, "day_pnl": -loss, "drawdown": fall}


def account_guard(curve: DataFrame, key: str = "account", ts: str = "ts", equity: str = "equity") -> DataFrame:
    """State of each account at each point of its curve."""
    ship_package(curve.sparkSession)
    kind = dict(curve.dtypes)[ts]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        state, rows = guard_start(), []
        for k, t, day, e in zip(pdf[key], pdf[ts], pdf["_day"], pdf[equity]):
            state, out = guard_step(state, day, e)
            rows.append((k, t, *out.values()))
        return pd.DataFrame(rows, columns=[key, ts, "state", "day_pnl", "drawdown"])

    return curve.select(key, ts, equity, F.date_format(ts, "yyyy-MM-dd").alias("_day")).groupBy(key).applyInPandas(run, f"{key} string, {ts} {kind}, state string, day_pnl double, drawdown double")


def filter_targets(targets: DataFrame, positions: DataFrame, state: Column, key: str = "symbol") -> DataFrame:
    """Targets (weight) met with positions (held) under the account's state.

    Halted: all go to nothing, held symbols without a target too. Reduce only: a target may not grow a position or turn
    it. Normal: targets as they are; a held symbol without one stays as it is.
    """
    df = targets.join(positions, key, "full_outer")
    held, want = F.coalesce("held", F.lit(0.0)), F.coalesce("weight", F.coalesce("held", F.lit(0.0)))
    less = F.when(F.signum(want) != F.signum(held), 0.0).otherwise(F.signum(held) * F.least(F.abs(want), F.abs(held)))
    return df.select(key, held.alias("held"), F.when(state == "halted", 0.0).when(state == "reduce_only", less).otherwise(want).alias("weight"))


VIEW = "struct<symbol:string,bias:string,confidence:double,rationale:string>"


def outside_views(rows: DataFrame, now: Column, halflife_hours: float, json: str = "payload", ts: str = "ts") -> DataFrame:
    """Views from JSON documents: a known bias and a confidence in [0, 1] or nothing; confidence halves with every half-life."""
    v = rows.select(ts, F.from_json(json, VIEW, {"mode": "PERMISSIVE"}).alias("v")).select(ts, "v.*")
    ok = F.col("symbol").isNotNull() & F.col("bias").isin("bullish", "bearish", "neutral") & F.col("confidence").between(0, 1)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3.6e9
    decayed = F.col("confidence") * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / halflife_hours)
    score = F.when(F.col("bias") == "bullish", 1.0).when(F.col("bias") == "bearish", -1.0).otherwise(0.0)
    return v.where(ok & (F.col("bias") != "neutral")).select("symbol", ts, score.alias("score"), decayed.alias("confidence"))


def stop_and_target(d: dict[str, Column], least_atr: float = 2.0, buffer_atr: float = 0.25, reward: float = 3.0) -> Column:
    """Struct (stop, objective, source): a pattern's stop, else a level's with a buffer, else so many ATRs.

    d: entry, atr, is_long, pattern_stop, pattern_objective, level (support below or resistance above), null where there
    is none. A stop nearer than least_atr is moved out; an objective nearer than reward times the risk is moved too.
    """
    side = F.when(d["is_long"], 1.0).otherwise(-1.0)
    level = d["level"] - side * buffer_atr * d["atr"]
    plain = d["entry"] - side * least_atr * d["atr"]
    right = lambda s: F.when((d["entry"] - s) * side > 0, s)
    stop = F.coalesce(right(d["pattern_stop"]), right(level), plain)
    source = F.when(right(d["pattern_stop"]).isNotNull(), "pattern").when(right(level).isNotNull(), "level").otherwise("atr")
    stop = F.when(F.abs(d["entry"] - stop) < least_atr * d["atr"], plain).otherwise(stop)
    far = d["entry"] + side * reward * F.abs(d["entry"] - stop)
    goal = F.coalesce(d["pattern_objective"], far)
    return F.struct(stop.alias("stop"), F.when((goal - far) * side < 0, far).otherwise(goal).alias("objective"), source.alias("source"))


def equity_scalar(equity: Column, start: Column, most: float = 1.5) -> Column:
    """Size against the starting equity: less after losses in proportion, more after gains up to a limit."""
    return F.when(start <= 0, 1.0).otherwise(F.least(F.greatest(equity / start, F.lit(0.0)), F.lit(most)))


# --- order routing ---


def router_start() -> dict:
    return {"working": None, "since": 0.0, "rejects": 0, "blocked_until": 0.0}


def router_step(s: dict, at: float, event: str, reduces: bool, timeout: float = 300.0, stale: float = 120.0, most: int = 3) -> tuple[dict, dict]:
    """One working order for each symbol. at: seconds; event: submit, fill, reject or kill.

    Three rejections in a row block the symbol for a while; a working order that is stale gives way; an order that only
    reduces always passes.
    """
    s = dict(s)
    if event == "kill":
        s.update(working=None)
        return s, {"action": "cancelled"}
    if event == "fill":
        s.update(working=None, rejects=0)
        return s, {"action": "done"}
    if event == "reject":
        s.update(working=None, rejects=s["rejects"] + 1)
        if s["rejects"] >= most:
            s.update(blocked_until=at + timeout, rejects=0)
            return s, {"action": "blocked"}
        return s, {"action": "rejected"}
    if s["working"] is not None and at - s["since"] < stale and not reduces:
        return s, {"action": "busy"}
    if at < s["blocked_until"] and not reduces:
        return s, {"action": "held"}
    replaced = s["working"] is not None
    s.update(working=at, since=at)
    return s, {"action": "replaced" if replaced else "sent"}


def route(orders: DataFrame, then: tuple[str, ...] = ()) -> DataFrame:
    """orders (symbol, ts, event, reduces) with what the router does with each; those of one ts go in order of ``then``."""
    from barloom.operators.kernels import scan

    df = orders.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return scan(df, router_start, lambda s, v: router_step(s, *v), ["at", "event", "reduces"], f"symbol string, ts {dict(orders.dtypes)['ts']}, action string", then=then)


# --- agents over structure ---


def structure_signals(v: DataFrame) -> DataFrame:
    """Opinions of the checklist, the structure and the divergence agents in long form.

    v, a row for each bar: symbol, ts, ready, permitted; the verdict's bias, score, agreement, conviction, coverage and
    n_blockers; direction, health, trend_confidence, headroom_up, headroom_down, uptrend_touches, downtrend_touches, fan,
    retraced, leg_up, adx, dmi_ready, rsi, bullish_divergences, bearish_divergences.
    """
    zero, one, free = F.lit(0), F.lit(1.0), F.lit(float("inf"))
    trend = F.when(F.col("direction") == "up", 1).when(F.col("direction") == "down", -1).otherwise(0)
    check = (F.col("n_blockers") == 0) & (F.col("bias") != 0) & (F.col("conviction") >= 0.20) & (F.col("coverage") >= 0.55)
    room = F.coalesce(F.when(trend > 0, F.col("headroom_up")).otherwise(F.col("headroom_down")), free)
    touches = F.when(trend > 0, F.col("uptrend_touches")).otherwise(F.col("downtrend_touches"))
    along = F.col("leg_up") == (trend > 0)
    back = F.col("retraced")
    # A leg of the trend that is more than two thirds undone ends the case; one between two fifths and three fifths is best.
    pulled = F.when(along & back.between(0.40, 0.60), 0.25).when(along & back.between(0.0, 0.66), 0.10).otherwise(0.0)
    drive = F.when(~F.col("dmi_ready"), 0.4).otherwise(0.4 + 0.6 * F.greatest(F.lit(0.0), F.least(one, (F.col("adx") - 20) / 20)))
    sure = clamp(F.col("trend_confidence") * drive, 0.0, 1.0)
    shape = F.col("ready") & (trend != 0) & (F.col("permitted") == trend) & F.col("health").isin("intact", "confirmed") & (room >= 1.5) & (F.coalesce("fan", zero) < 3)
    shape = shape & ~F.coalesce(along & (back > 0.66), F.lit(False)) & (~F.col("dmi_ready") | (F.col("adx") >= 20)) & (sure > 0.05)
    strength = F.least(one, 0.45 + F.least(F.lit(0.25), 0.08 * F.coalesce(touches, zero)) + pulled)
    up, down = F.coalesce("bullish_divergences", zero), F.coalesce("bearish_divergences", zero)
    turn, n = F.when(up > down, 1).otherwise(-1), F.when(up > down, up).otherwise(down)
    div = F.col("ready") & (n >= 2) & (trend == -turn) & F.when(turn < 0, F.col("rsi") >= 60).otherwise(F.col("rsi") <= 40)

    def opinion(holds, agent: str, score, confidence, horizon: int):
        return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(agent).alias("agent"), score.cast("double").alias("score"), confidence.cast("double").alias("confidence"), F.lit(horizon).alias("horizon")))

    each = F.array_compact(F.array(
        opinion(check, "checklist", F.col("score"), F.least(one, 0.35 + 0.65 * F.col("agreement")), 48),
        opinion(shape, "structure", trend * strength, sure, 36),
        opinion(div, "divergence", turn * 0.5, F.least(F.lit(0.7), 0.25 + 0.15 * n), 18),
    ))
    return v.select("symbol", "ts", F.inline(each))


def formation_signals(bars: DataFrame, living: DataFrame, candles: DataFrame, waves: DataFrame) -> DataFrame:
    """Opinions of the agents that read patterns, candles and wave counts, in long form.

    bars: symbol, ts, ready, permitted, close, atr, nearest (level). living: patterns.live. candles: signals. waves: the best
    count as known on each bar, with its bias (1, -1, 0), confidence and n_violations.
    """
    from barloom.bars import numbered
    from barloom.operators import patterns as P

    state = bars.where("ready").select("symbol", "ts", "permitted")
    sig, bias = F.col("significance"), F.col("bias")
    met = (F.col("objective") > 0) & F.when(bias > 0, F.col("high") >= F.col("objective")).otherwise(F.col("low") <= F.col("objective"))
    fresh = living.where((sig >= 0.35) & (P.reward_risk(F.col("objective"), F.col("broke_at"), F.col("stop")) >= 3) & P.volume_confirms(bias, F.col("volume_ratio")) & (F.col("i") - F.col("breakout_index") <= 20) & ~met)
    lead = F.max_by(F.struct("bias", "significance", "stage", (F.col("end_index") - F.col("first_index")).alias("bars")), F.struct("significance", "detected_index", "id"))
    p = fresh.groupBy("symbol", "ts").agg(lead.alias("b"), F.sum(F.when(bias > 0, sig).otherwise(0.0)).alias("up"), F.sum(F.when(bias < 0, sig).otherwise(0.0)).alias("down")).join(state, ["symbol", "ts"])
    p = p.withColumn("consensus", F.col("b.bias") * (F.col("up") - F.col("down")) / (F.col("up") + F.col("down"))).where("permitted = b.bias AND consensus > 0")
    p = p.withColumn("confidence", clamp(F.col("b.significance") * F.col("consensus") + F.when(F.col("b.stage") == "return_move", 0.1).otherwise(0.0), 0.0, 1.0)).where("confidence >= 0.1")
    p = p.select("symbol", "ts", F.lit("patterns").alias("agent"), (F.col("b.bias") * F.least(F.lit(1.0), 0.5 + 0.5 * F.col("consensus"))).alias("score"), "confidence", F.greatest(F.lit(12), F.col("b.bars")).alias("horizon"))
    # A candle counts on its bar and the three after it.
    at = numbered(bars).select("symbol", "ts", "i")
    c = candles.where("bias <> 0 AND strength >= 0.55 AND sessions >= 2").join(at, ["symbol", "ts"]).withColumn("i", F.explode(F.sequence(F.col("i"), F.col("i") + 3))).drop("ts")
    # Of equal ones the one that came first counts.
    c = c.join(at, ["symbol", "i"]).groupBy("symbol", "ts").agg(F.max_by(F.struct("bias", "strength", "sessions"), F.struct("strength", "sessions")).alias("b"))
    c = c.join(bars.where("ready AND atr > 0").select("symbol", "ts", "permitted", "close", "atr", "nearest"), ["symbol", "ts"])
    c = c.where((F.col("permitted") == F.col("b.bias")) & (F.abs(F.col("close") - F.col("nearest")) <= F.col("atr")))
    sure = F.least(F.lit(1.0), F.col("b.strength") * (0.7 + 0.1 * F.col("b.sessions")))
    c = c.select("symbol", "ts", F.lit("candles").alias("agent"), (F.col("b.bias") * F.least(F.lit(1.0), 0.4 + 0.4 * F.col("b.strength"))).alias("score"), sure.alias("confidence"), F.lit(8).alias("horizon"))
    w = waves.where("bias <> 0 AND confidence >= 0.6 AND n_violations = 0").join(state, ["symbol", "ts"]).where("permitted = bias")
    w = w.select("symbol", "ts", F.lit("waves").alias("agent"), (0.5 * F.col("bias")).alias("score"), F.least(F.lit(1.0), 0.8 * F.col("confidence")).alias("confidence"), F.lit(60).alias("horizon"))
    return p.unionByName(c).unionByName(w)
