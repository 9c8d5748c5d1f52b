"""Patterns, timeframes, the checklist and its verdict, and discipline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.operators import candles as C
from barloom.operators import discipline as D
from barloom.operators import elliott as W
from barloom.operators import kernels as K
from barloom.operators import lines as L
from barloom.operators import multiframe as M
from barloom.operators import patterns as P
from barloom.operators import structure as S
from barloom.plans.q_metrics import rounded
from barloom.plans.q_recursions import DMI, RSI
from barloom.plans.q_structure import TREND
from barloom.plans.q_windows import bars
from barloom.plans.registry import query
from barloom.plans.sql import with_bars
from barloom.session import materialise


def found(b: DataFrame, pivots: DataFrame, trend: str | None = None) -> DataFrame:
    return P.recognise(pivots, b, trend=trend).unionByName(P.flags(b)).unionByName(P.spikes(b, S.extremes_since_pivot(b, pivots), pivots))


def trended(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Bars with their ATR and the trend's sign, and pivots, both as tables."""
    b = materialise(I.atr(bars(spark, sf)), "bars")
    pivots = materialise(K.swings(b), "pivots")
    way = S.dow_trend(b, pivots).select("symbol", "ts", M.sign_of(F.col("direction")).alias("way"))
    return materialise(b.join(way, ["symbol", "ts"]), "trended"), pivots


@query()
def patterns(spark: SparkSession, sf: str) -> DataFrame:
    b, pivots = trended(spark, sf)
    return rounded(found(b, pivots, "way").withColumn("points", F.array_join("points", ",")))


@query()
def pattern_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    b, pivots = trended(spark, sf)
    return rounded(P.lifecycle(materialise(found(b, pivots, "way"), "patterns"), b))


@query()
def live_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The significance of each live pattern on every bar, and what all of them say together."""
    b, pivots = trended(spark, sf)
    living = materialise(P.live(P.lifecycle(materialise(found(b, pivots, "way"), "patterns"), b), b), "living")
    return rounded(living.select("symbol", "ts", "id", "pattern", "stage", "bias", "significance").join(P.pattern_bias(living), ["symbol", "ts"], "left"))


@query()
def frame_stack(spark: SparkSession, sf: str) -> DataFrame:
    s = M.frame_stack(B.event_bars(spark, sf).select(*B.BAR))
    return s.select("symbol", "ts", "direction", "permitted", F.round("alignment", 6).alias("alignment"), "n_direction")


def study(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """What the checklist and the agents read: ``evidence``, a wide row for each bar, ``living`` patterns and candle ``signals``."""
    b = B.event_bars(spark, sf).select(*B.BAR)
    # Many operators read the same bars and pivots: both are tables, so each is computed once.
    b = materialise(b, "bars")
    keys = ["symbol", "ts"]
    stack = materialise(M.frame_stack(b).select(*keys, "direction", "health", F.col("confidence").alias("trend_confidence"), "pivots_used", "permitted", "alignment", "n_direction"), "stack")
    a = I.stochastic(I.macd(I.dmi(I.rsi(I.atr(M.ma_slope_bias(b))))))
    a = materialise(a.join(stack.select(*keys, M.sign_of(F.col("direction")).alias("way")), keys), "features")
    pivots = materialise(K.swings(a), "pivots")
    lv = L.levels(a, pivots).select(*keys, "headroom_up", "headroom_down", "nearest", "n_levels")
    lines = L.line_states(a, pivots).select(*keys, "line_bias", F.col("n_active").alias("n_lines"), "uptrend_touches", "downtrend_touches", "fan")
    last_leg = S.legs(pivots).select(*keys, F.struct(F.col("start_price").alias("start"), F.col("price").alias("end"), "is_up").alias("leg"))
    ell = W.elliott_best(W.elliott_counts(pivots)).join(pivots.select("symbol", "confirmed_index", "ts"), ["symbol", "confirmed_index"])
    ell = ell.select(*keys, F.struct(F.when(F.col("bias") == "bullish", 1).when(F.col("bias") == "bearish", -1).otherwise(0).alias("bias"), "confidence", "n_violations").alias("ell"))
    div = materialise(S.divergence_counts(pivots, a, ["rsi", "macd", "slow_k"]), "divergences")
    trend = a.withColumn("prior_trend", F.col("way"))
    signals = materialise(C.candle_signals(trend), "candles")
    nb = C.net_bias(trend, signals).withColumnRenamed("net_bias", "candle_bias")
    has = signals.groupBy(*keys).agg(F.lit(True).alias("has_candle"))
    living = materialise(P.live(P.lifecycle(materialise(found(a, pivots, "way"), "patterns"), a), a), "living")
    reversal = F.col("pattern").isin([k for k, (_, r) in P.KINDS.items() if r])
    of = {"reversal": reversal, "continuation": ~reversal}
    sig = F.col("significance")
    pat = living.groupBy(*keys).agg(*[f.alias(f"{k}_{n}") for k, on in of.items() for n, f in (("mass", F.sum(F.when(on, sig))), ("net", F.sum(F.when(on, sig * F.col("bias")))), ("n", F.count_if(on)))])
    gaps = materialise(S.gaps(a), "gaps")
    # An exhaustion gap comes at the end of its move.
    way = F.when(F.col("up"), 1).otherwise(-1) * F.when(F.col("type") == "exhaustion", -1).otherwise(1)
    gap_sides = gaps.select(*keys, "up").join(S.typed_gaps(gaps, a, pivots), keys).select(*keys, way.alias("gap_bias"))
    df = a.join(stack, keys).join(lv, keys).join(lines, keys).join(nb, keys).join(has, keys, "left").join(pat, keys, "left").join(gap_sides, keys, "left")
    df = materialise(df, "joined")
    df = B.as_of(df, last_leg, ["symbol"], "ts", ["leg"])
    df = B.as_of(df, materialise(ell, "waves"), ["symbol"], "ts", ["ell"])
    for kind, name in (("peak", "bearish_divergences"), ("trough", "bullish_divergences")):
        df = B.as_of(df, div.where(F.col("kind") == kind).select(*keys, F.col("diverging").alias(name)), ["symbol"], "ts", [name])
    recent = F.last("gap_bias", ignorenulls=True).over(B.by_symbol().rowsBetween(-20, 0))
    df = df.withColumns({
        "ready": (F.col("n") >= 50) & (F.col("pivots_used") >= 2), "rsi_ready": F.col("n") >= 15, "dmi_ready": F.col("n") >= 29, "leg_up": F.col("leg.is_up"), "retraced": S.signed_retracement(F.col("leg.start"), F.col("leg.end"), F.col("close")),
        "elliott_bias": F.col("ell.bias"), "elliott_confidence": F.col("ell.confidence"), "gap_bias": recent, "has_candle": F.coalesce("has_candle", F.lit(False)),
    })
    return {"evidence": materialise(df, "evidence"), "living": living, "signals": signals}


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The wide row of each bar that the checklist reads."""
    return study(spark, sf)["evidence"]


@query()
def checklist_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.checklist(evidence(spark, sf)))


@query()
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence(spark, sf)
    v = M.verdict(M.checklist(e), e.select("symbol", "ts", "ready", "permitted"))
    return rounded(v.withColumn("blockers", F.array_join("blockers", ",")))


@query(
    """WITH t AS (SELECT o_custkey AS trade, o_orderkey AS seq, o_orderkey % 2 = 0 AS is_long, round(o_totalprice, 2) AS stop, lag(round(o_totalprice, 2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
e AS (SELECT trade, seq, CASE WHEN before IS NULL THEN NULL WHEN is_long AND stop < before THEN 'violation' WHEN NOT is_long AND stop > before THEN 'violation' WHEN stop <> before THEN 'kept' END AS outcome FROM t)
SELECT trade, seq, principle, outcome FROM (SELECT trade, seq, outcome, unnest(CASE WHEN outcome = 'violation' THEN ['accept_risk', 'never_violate'] ELSE ['accept_risk'] END) AS principle FROM e WHERE outcome IS NOT NULL)"""
)
def stop_discipline(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of a trade's stop: moving it away from price breaks two principles, moving it closer keeps one."""
    o = B.read(spark, sf, "orders").select(F.col("o_custkey").alias("trade"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 2 == 0).alias("is_long"), F.round("o_totalprice", 2).alias("stop"))
    return D.stop_changes(o, "trade", "seq")


@query(
    """WITH e AS (SELECT event_type AS principle, CASE WHEN value > 60 THEN 'violation' WHEN value > 30 THEN 'warning' ELSE 'kept' END AS severity FROM events)
SELECT principle, count(*) AS events, CAST(count_if(severity = 'violation') AS BIGINT) AS violations, CAST(count_if(severity = 'warning') AS BIGINT) AS warnings, round(count_if(severity = 'kept') / count(*), 6) AS kept_rate FROM e GROUP BY 1"""
)
def adherence_report(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("value") > 60, "violation").when(F.col("value") > 30, "warning").otherwise("kept")
    e = B.read(spark, sf, "events").select(F.col("event_type").alias("principle"), severity.alias("severity"))
    return rounded(D.adherence(e))


@query("SELECT event_type AS symbol, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events WHERE NOT starts_with(props, 'no agent') AND NOT contains(coalesce(props, ''), 'rebalance threshold')) WHERE k <= 40")
def blotter(spark: SparkSession, sf: str) -> DataFrame:
    """The newest forty rows of each symbol without the noise of decisions that were none."""
    e = B.read(spark, sf, "events").where(~F.startswith("props", F.lit("no agent")) & ~F.contains(F.coalesce("props", F.lit("")), F.lit("rebalance threshold")))
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"))
    return e.withColumn("k", F.row_number().over(w)).where("k <= 40").select(F.col("event_type").alias("symbol"), "ts", "value")


@query(
    with_bars(
        """SELECT te.symbol, te.ts, te.close, round(te.close / nullif(p.close, 0) - 1, 6) AS change, direction, health, round(ad.v, 6) AS adx, round(a.v / nullif(te.close, 0), 6) AS atr_pct,
  round(CASE WHEN te.n = 1 THEN 50 WHEN l.v <= 1e-12 THEN CASE WHEN g.v > 1e-12 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g.v / l.v) END, 6) AS rsi
FROM (SELECT * FROM te QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1) te LEFT JOIN b p ON p.symbol = te.symbol AND p.n = te.n - 1 JOIN ad ON ad.symbol = te.symbol AND ad.m = te.n - 1 JOIN a ON a.symbol = te.symbol AND a.n = te.n
  LEFT JOIN g ON g.symbol = te.symbol AND g.n = te.n - 1 LEFT JOIN l ON l.symbol = te.symbol AND l.n = te.n - 1""",
        *TREND,
        *DMI[1:],
        *RSI,
        recursive=True,
    )
)
def market_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """One line for each symbol: last price and change, trend, ADX, RSI, ATR share."""
    b = materialise(I.dmi(I.rsi(I.atr(bars(spark, sf)))), "bars")
    t = S.dow_trend(b, K.swings(b)).withColumn("change", F.col("close") / F.nullif(F.lag("close").over(B.by_symbol()), F.lit(0.0)) - 1)
    last = t.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "change", "direction", "health", "adx", "rsi", (F.col("atr") / F.nullif(F.col("close"), F.lit(0.0))).alias("atr_pct")), "ts").alias("r"))
    return rounded(last.select("symbol", "r.*"))


@query()
def formation_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Opinions from patterns, candles near levels, and wave counts."""
    from barloom.operators import routing as R

    t = study(spark, sf)
    waves = t["evidence"].select("symbol", "ts", F.col("ell.bias").alias("bias"), F.col("ell.confidence").alias("confidence"), F.col("ell.n_violations").alias("n_violations"))
    return rounded(R.formation_signals(t["evidence"], t["living"], t["signals"], waves))
