"""Signal agents: each a pure function of one feature row (or of all symbols' latest), in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import linear_map, squash
from barloom.operators.cross_section import peers_as_of

#: Trust and horizon of each agent.
WEIGHTS = {"momentum": 1.0, "mean_reversion": 0.9, "breakout": 0.85, "rel_strength": 0.8}
HORIZON = {"momentum": 24, "mean_reversion": 8, "breakout": 16, "rel_strength": 32}


def _opinion(score: Column, confidence: Column, holds: Column) -> Column:
    """A struct, or null where the agent has no view; scores stay in [-1, 1] and confidence in [0, 1]."""
    s, c = F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0)), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(s.alias("score"), c.alias("confidence")))


def momentum() -> Column:
    spread, slope = F.col("ema_spread") / F.col("atr_pct"), F.col("ema_slope") / F.col("atr_pct")
    score = squash(spread, 1.5)
    up = score > 0
    sure = F.when((slope > 0) == up, 0.85).otherwise(0.40)
    sure = F.when((F.col("roc_slow") > 0) == up, F.least(sure + 0.15, F.lit(1.0))).otherwise(sure)
    stretched = F.when(up, F.col("rsi")).otherwise(100 - F.col("rsi"))
    sure = sure * F.when(stretched > 75, linear_map(stretched, 75, 95, 1.0, 0.35)).otherwise(1.0)
    return _opinion(score, sure, (F.col("atr_pct") > 1e-9) & (F.abs(score) >= 0.05))


def mean_reversion() -> Column:
    spread = F.abs(F.col("ema_spread") / F.col("atr_pct"))
    z, vol, rsi = F.col("zscore"), F.col("vol_percentile"), F.col("rsi")
    score = -squash(z, 1.6)
    # The oversold side's range runs downwards and so gives its low end.
    sure = F.when(score > 0, linear_map(rsi, 45, 20, 0.5, 1.0)).otherwise(linear_map(rsi, 55, 80, 0.5, 1.0))
    sure = sure * F.when(vol > 0.75, linear_map(vol, 0.75, 1.0, 1.0, 0.3)).otherwise(1.0)
    sure = F.when(vol < 0.4, F.least(sure * 1.15, F.lit(1.0))).otherwise(sure)
    return _opinion(score, sure, (F.col("atr_pct") > 1e-9) & (spread <= 1.2) & (F.abs(z) >= 0.7) & (sure >= 0.15))


def breakout(edge: float = 0.90) -> Column:
    width, pos, vz = (F.col("don_high") - F.col("don_low")) / F.col("atr"), F.col("channel_pos"), F.col("volume_z")
    up, down = pos >= edge, pos <= 1 - edge
    score = F.when(up, linear_map(pos, edge, 1.0, 0.35, 1.0)).otherwise(-linear_map(pos, 1 - edge, 0.0, 0.35, 1.0))
    sure = linear_map(vz, -0.25, 2.0, 0.45, 1.0)
    sure = F.when((F.col("ema_spread") > 0) == up, F.least(sure + 0.15, F.lit(1.0))).otherwise(sure)
    return _opinion(score, sure, (F.col("atr") > 1e-12) & (F.col("close") > 0) & (width >= 2.5) & (up | down) & (vz >= -0.25))


def relative_strength(df: DataFrame) -> DataFrame:
    """df with ``rel_strength``: the rank of risk-adjusted momentum among the latest snapshots of all symbols that are ready.

    A peer counts with its latest bar, whenever that was: no bar at the very same time is needed.
    """
    ok = F.col("ready") & (F.col("realized_vol") > 1e-9)
    df = peers_as_of(df.withColumn("_m", F.when(ok, F.round(F.col("roc_slow") / F.col("realized_vol"), 9))), "_m")
    spread = F.col("peer_spread")
    score = F.when(F.col("peers") > 1, F.col("peer_place") / (F.col("peers") - 1) * 2 - 1)
    relative = F.when(spread > 1e-12, F.abs(F.col("_m") - F.col("peer_mean")) / spread).otherwise(0.0)
    sure = F.least(relative * 2, F.lit(1.0)) * linear_map(spread, 0.02, 0.08, 0.0, 1.0)
    holds = F.col("_m").isNotNull() & (F.col("peers") >= 3) & (sure >= 0.15) & (F.abs(score) >= 0.2)
    return df.withColumn("rel_strength", _opinion(score, sure, holds)).drop("_m", "peers", "peer_place", "peer_spread", "peer_mean")


def regime_appetite(pct: Column) -> Column:
    """Appetite for risk from the percentile of volatility: whole up to 70%, a quarter from 97% on."""
    return F.when(pct <= 0.70, 1.0).otherwise(linear_map(pct, 0.70, 0.97, 1.0, 0.25))


def regime_label(pct: Column) -> Column:
    return F.when(pct <= 0.70, "normal").when(pct < 0.97, "elevated").otherwise("stressed")


def signals(features: DataFrame) -> DataFrame:
    """symbol, ts, agent, score, confidence, horizon: one row for each opinion on ready bars."""
    df = relative_strength(features).withColumns({"momentum": momentum(), "mean_reversion": mean_reversion(), "breakout": breakout()}).where("ready")
    each = [F.struct(F.lit(a).alias("agent"), F.lit(HORIZON[a]).alias("horizon"), F.col(a).alias("v")) for a in WEIGHTS]
    return df.select("symbol", "ts", F.explode(F.filter(F.array(*each), lambda s: s["v"].isNotNull())).alias("s")).select("symbol", "ts", "s.agent", "s.v.score", "s.v.confidence", "s.horizon")
