"""From opinions to positions: blending, exposure caps, confidence, leverage, sizing and order checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import clamp


@dataclass(frozen=True)
class Blend:
    least_score: float = 0.15
    most_weight: float = 0.20
    gross: float = 1.0
    net: float = 0.60
    target_vol: float = 0.20
    scalar: tuple[float, float] = (0.25, 2.5)


def vol_scalar(vol: Column, cfg: Blend = Blend()) -> Column:
    return F.when(vol.isNull() | (vol <= 1e-6), cfg.scalar[0]).otherwise(F.least(F.greatest(cfg.target_vol / vol, F.lit(cfg.scalar[0])), F.lit(cfg.scalar[1])))


def blend(signals: DataFrame, state: DataFrame, weights: dict[str, float] | None = None, cfg: Blend = Blend()) -> DataFrame:
    """signals (symbol, ts, agent, score, confidence) and state (symbol, ts, realized_vol, appetite) -> target weights."""
    w = F.lit(1.0)
    for agent, x in (weights or {}).items():
        w = F.when(F.col("agent") == agent, float(x)).otherwise(w)
    s = signals.withColumn("_w", w).where("_w > 0").withColumn("_e", F.col("_w") * F.col("confidence"))
    g = s.groupBy("symbol", "ts").agg(F.sum(F.col("_e") * F.col("score")).alias("_num"), F.sum("_e").alias("_den"), F.sum("_w").alias("_all"), F.count(F.lit(1)).alias("agents"))
    g = g.where("_den > 1e-9 AND _all > 1e-9").withColumns({"consensus": F.col("_num") / F.col("_den"), "conviction": F.least(F.col("_den") / F.col("_all"), F.lit(1.0))})
    g = g.join(state, ["symbol", "ts"])
    raw = F.col("consensus") * F.col("conviction") * vol_scalar(F.col("realized_vol"), cfg) * F.col("appetite")
    capped = F.least(F.greatest(raw, F.lit(-cfg.most_weight)), F.lit(cfg.most_weight))
    return g.withColumn("weight", F.when(F.abs("consensus") < cfg.least_score, 0.0).otherwise(capped)).drop("_num", "_den", "_all")


def exposure_caps(targets: DataFrame, cfg: Blend = Blend(), at: str = "ts") -> DataFrame:
    """Weights of one time scaled to the gross limit, then the heavier side shrunk to the net limit."""
    w = Window.partitionBy(at)
    df = targets.withColumn("_gross", F.sum(F.abs("weight")).over(w))
    df = df.withColumn("weight", F.when(F.col("_gross") > cfg.gross, F.col("weight") * cfg.gross / F.col("_gross")).otherwise(F.col("weight")))
    df = df.withColumns({"_net": F.sum("weight").over(w)})
    same = F.signum("weight") == F.signum("_net")
    df = df.withColumn("_side", F.sum(F.when(same, F.abs("weight")).otherwise(0.0)).over(w))
    factor = F.greatest(1 - (F.abs("_net") - cfg.net) / F.col("_side"), F.lit(0.0))
    over = (F.abs("_net") > cfg.net) & same & (F.col("_side") > 1e-9)
    return df.withColumn("weight", F.when(over, F.col("weight") * factor).otherwise(F.col("weight"))).drop("_gross", "_net", "_side")


#: Parts of the confidence score and their weights.
PARTS = {"checklist": 0.28, "agreement": 0.12, "consensus": 0.20, "timeframe": 0.16, "structure": 0.12, "regime": 0.07, "funding": 0.05}


def confidence(e: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """Score in [0, 1] and its parts, from the evidence's columns."""
    breadth = F.least(F.lit(1.0), F.sqrt(F.greatest(e["agents"], F.lit(0)) / 6.0))
    parts = {
        "checklist": clamp(e["conviction"], 0.0, 1.0),
        "agreement": clamp(e["agreement"], 0.0, 1.0),
        "consensus": clamp(e["consensus"] * breadth, 0.0, 1.0),
        "timeframe": F.when(e["aligned"], 1.0).otherwise(0.0),
        "structure": F.when(e["has_stop"], clamp(0.6 + 0.4 * clamp((e["reward_risk"] - 3) / 3, 0.0, 1.0), 0.0, 1.0)).otherwise(0.0),
        "regime": clamp(e["appetite"], 0.0, 1.0),
        "funding": clamp(1 - F.greatest(e["funding"], F.lit(0.0)) / 0.20, 0.0, 1.0),
    }
    raw = sum((parts[k] * w for k, w in PARTS.items()), F.lit(0.0)) / sum(PARTS.values())
    raw = F.when(e["blockers"] > 0, raw * 0.25).otherwise(raw)
    raw = F.when(e["coverage"] < 0.5, raw * (0.5 + e["coverage"])).otherwise(raw)
    return clamp(raw, 0.0, 1.0), parts


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.80, "very strong").when(score >= 0.65, "strong").when(score >= 0.50, "moderate").when(score >= 0.35, "weak").otherwise("not tradable")


def leverage(score: Column, stop_pct: Column, maint: float = 0.005, user_cap: float = 100.0, venue_cap: float = 125.0, safety: float = 0.55, gamma: float = 2.2) -> Column:
    """Struct of the multiplier, what bound it and the adverse move that liquidates."""
    asked = 1 + F.pow(clamp(score, 0.0, 1.0), F.lit(gamma)) * (max(1.0, user_cap) - 1)
    room = F.when(stop_pct <= 0, 1.0).otherwise(F.greatest(safety / (stop_pct + max(0.0, maint)), F.lit(1.0)))
    options = F.array(*[F.struct(v.alias("x"), F.lit(k).alias("rank"), F.lit(name).alias("name")) for k, (v, name) in enumerate(
        [(asked, "confidence"), (room, "liquidation"), (F.lit(max(1.0, venue_cap)), "venue"), (F.lit(max(1.0, user_cap)), "requested")])])
    best = F.array_min(options)
    x = F.greatest(best["x"], F.lit(1.0))
    return F.struct(x.alias("leverage"), best["name"].alias("binding"), F.greatest(1 / x - maint, F.lit(0.0)).alias("liquidation_move"))


@dataclass(frozen=True)
class Money:
    invested: float = 0.50
    market: float = 0.10
    group: float = 0.20
    risk_cap: float = 0.05
    risk_target: float = 0.005
    reward_risk: float = 3.0
    decay: float = 0.5
    layers: int = 3


def size_plan(p: dict[str, Column], rules: Money = Money(), step: float = 0.0) -> Column:
    """Struct (qty, risk, reward_risk, binding, refusal) for a planned position.

    p: entry, stop, objective, equity, invested (others' margin), group_invested (the group's others), leverage, layer, conviction.
    """
    risk_unit = F.abs(p["entry"] - p["stop"])
    is_long = p["stop"] < p["entry"]
    rr = F.abs(p["objective"] - p["entry"]) / risk_unit
    has_objective = p["objective"] > 0
    wrong = has_objective & F.when(is_long, p["objective"] <= p["entry"]).otherwise(p["objective"] >= p["entry"])
    room, room_group = rules.invested * p["equity"] - p["invested"], rules.group * p["equity"] - p["group_invested"]
    unit = p["entry"] / F.greatest(p["leverage"], F.lit(1e-9))
    risk = min(rules.risk_target if rules.risk_target > 0 else rules.risk_cap, rules.risk_cap) * p["equity"]
    limits = [(risk / risk_unit, "risk"), (rules.market * p["equity"] / unit, "market"), (room / unit, "invested"), (room_group / unit, "group")]
    best = F.array_min(F.array(*[F.struct(v.alias("x"), F.lit(k).alias("rank"), F.lit(n).alias("name")) for k, (v, n) in enumerate(limits)]))
    qty = best["x"] * F.when(p["layer"] > 1, F.pow(F.lit(rules.decay), p["layer"] - 1)).otherwise(1.0) * clamp(p["conviction"], 0.0, 1.0)
    qty = F.floor(qty / step) * step if step > 0 else qty
    refusal = (
        F.when((p["entry"] <= 0) | (p["stop"] <= 0) | (risk_unit <= 0), "no_stop")
        .when(wrong, "stop_wrong_side")
        .when(has_objective & (rr < rules.reward_risk), "reward_too_small")
        .when(p["equity"] <= 0, "size_zero")
        .when(room <= 0, "portfolio_full")
        .when(room_group <= 0, "group_full")
        .when((p["layer"] > rules.layers) | (qty <= 0), "size_zero")
        .when(qty * risk_unit / p["equity"] > rules.risk_cap + 1e-9, "risk_too_wide")
    )
    ok = refusal.isNull()
    return F.struct(F.when(ok, qty).otherwise(0.0).alias("qty"), F.when(ok, qty * risk_unit).otherwise(0.0).alias("risk"), F.when(has_objective & (risk_unit > 0), rr).otherwise(0.0).alias("reward_risk"), F.when(ok, best["name"]).alias("binding"), refusal.alias("refusal"))


def check_order(o: dict[str, Column], order_cap: float = 0.35, symbol_cap: float = 0.20, gross_cap: float = 1.0, net_cap: float = 0.6, least: float = 25.0) -> Column:
    """Struct (approved, notional, reason). o: notional (signed), position, gross, net, equity, state ('normal', 'reduce_only', 'halted'), cooling.

    An order that only reduces passes; others are resized to the room that is left.
    """
    n, pos = o["notional"], o["position"]
    reduces = (n * pos < 0) & (F.abs(n) <= F.abs(pos))
    e = o["equity"]
    room = F.least(order_cap * e, F.greatest(symbol_cap * e - F.abs(pos), F.lit(0.0)), F.greatest(gross_cap * e - o["gross"], F.lit(0.0)), F.greatest(net_cap * e - F.signum(n) * o["net"], F.lit(0.0)))
    size = F.least(F.abs(n), room)
    reason = F.when(reduces, "reducing").when(o["state"] != "normal", o["state"]).when(o["cooling"], "cooldown").when(size < least, "too_small").when(size < F.abs(n), "resized").otherwise("ok")
    passed = reason.isin("reducing", "resized", "ok")
    return F.struct(passed.alias("approved"), F.when(~passed, 0.0).when(reduces, n).otherwise(F.signum(n) * size).alias("notional"), reason.alias("reason"))
