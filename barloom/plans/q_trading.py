"""Agents, blending, confidence, leverage, sizing and order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.operators import agents as A
from barloom.operators import portfolio as P
from barloom.plans.q_windows import bars
from barloom.plans.registry import query
from barloom.plans.sql import ORDER, TRUE_RANGE, peers, smoothing, with_bars, w
from barloom.session import materialise

_LIN = "({lo} + greatest(least(({x} - {a}) / {d}::DOUBLE, 1), 0) * {span}::DOUBLE)"


def lin(x: str, a: float, b: float, lo: float, hi: float) -> str:
    return _LIN.format(x=x, a=f"{a}::DOUBLE", d=b - a, lo=f"{lo}::DOUBLE", span=hi - lo)


FEATURES = (
    TRUE_RANGE,
    smoothing("f", "b", "close", 12, "2.0::DOUBLE / 13"),
    smoothing("s", "b", "close", 26, "2.0::DOUBLE / 27"),
    smoothing("a", "tr", "t", 14, "1.0::DOUBLE / 14"),
    f"d AS MATERIALIZED (SELECT symbol, ts, n, n - 1 AS m, greatest(close - lag(close) OVER ({ORDER}), 0) AS up, greatest(lag(close) OVER ({ORDER}) - close, 0) AS dn FROM b)",
    smoothing("g", "d", "up", 14, "1.0::DOUBLE / 14", "m"),
    smoothing("l", "d", "dn", 14, "1.0::DOUBLE / 14", "m"),
    f"r AS (SELECT symbol, n, CASE WHEN abs(lag(close) OVER ({ORDER})) > 1e-12 THEN (close - lag(close) OVER ({ORDER})) / lag(close) OVER ({ORDER}) ELSE 0 END AS ret, ts FROM b)",
    f"v AS (SELECT symbol, ts, n, coalesce(stddev_samp(ret) OVER {w(50)}, 0) * sqrt(8760) AS rv FROM r)",
    f"vp AS (SELECT symbol, n, rv, len(list_filter(q, lambda x: x <= rr)) / len(q)::DOUBLE AS pct FROM (SELECT *, round(rv, 8) AS rr, list(round(rv, 8)) OVER {w(200)} AS q FROM v))",
    f"""y AS (SELECT symbol, ts, n, CASE WHEN abs(first_value(close) OVER {w(53)}) < 1e-12 THEN 0 ELSE (close - first_value(close) OVER {w(53)}) / first_value(close) OVER {w(53)} END AS roc,
  CASE WHEN coalesce(stddev_samp(close) OVER {w(50)}, 0) <= 1e-12 THEN 0 ELSE (close - avg(close) OVER {w(50)}) / stddev_samp(close) OVER {w(50)} END AS z,
  CASE WHEN coalesce(stddev_samp(volume) OVER {w(50)}, 0) <= 1e-12 THEN 0 ELSE (volume - avg(volume) OVER {w(50)}) / stddev_samp(volume) OVER {w(50)} END AS vz, max(high) OVER {w(40)} AS dh, min(low) OVER {w(40)} AS dl FROM b)""",
    """ft AS MATERIALIZED (SELECT b.symbol, b.ts, b.n, b.close, CASE WHEN abs(b.close) <= 1e-12 THEN 0 ELSE (f.v - s.v) / b.close END AS spread, CASE WHEN abs(b.close) <= 1e-12 THEN 0 ELSE (s.v - coalesce(p.v, s.v)) / b.close END AS slope,
  CASE WHEN abs(b.close) <= 1e-12 THEN 0 ELSE a.v / b.close END AS atr_pct, a.v AS atr, CASE WHEN b.n = 1 THEN 50 WHEN l.v <= 1e-12 THEN CASE WHEN g.v > 1e-12 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g.v / l.v) END AS rsi,
  y.roc, y.z, y.vz, y.dh, y.dl, CASE WHEN y.dh - y.dl <= 1e-12 THEN 0.5 ELSE greatest(least((b.close - y.dl) / (y.dh - y.dl), 1), 0) END AS pos, vp.rv, vp.pct, b.n >= 52 AS ready
  FROM b JOIN f ON f.symbol = b.symbol AND f.n = b.n JOIN s ON s.symbol = b.symbol AND s.n = b.n LEFT JOIN s p ON p.symbol = b.symbol AND p.n = b.n - 1 JOIN a ON a.symbol = b.symbol AND a.n = b.n
  LEFT JOIN g ON g.symbol = b.symbol AND g.n = b.n - 1 LEFT JOIN l ON l.symbol = b.symbol AND l.n = b.n - 1 JOIN y ON y.symbol = b.symbol AND y.n = b.n JOIN vp ON vp.symbol = b.symbol AND vp.n = b.n)""",
    f"""mo AS (SELECT symbol, ts, 'momentum' AS agent, score, c * CASE WHEN x > 75 THEN {lin('x', 75, 95, 1.0, 0.35)} ELSE 1 END AS confidence, 24 AS horizon FROM (
  SELECT symbol, ts, score, CASE WHEN (roc > 0) = (score > 0) THEN least(c + 0.15::DOUBLE, 1) ELSE c END AS c, CASE WHEN score > 0 THEN rsi ELSE 100 - rsi END AS x FROM (
  SELECT *, CASE WHEN (slope / atr_pct > 0) = (score > 0) THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS c FROM (SELECT *, tanh(spread / atr_pct / 1.5::DOUBLE) AS score FROM ft WHERE ready AND atr_pct > 1e-9) WHERE abs(score) >= 0.05)))""",
    f"""mr AS (SELECT symbol, ts, 'mean_reversion' AS agent, score, c AS confidence, 8 AS horizon FROM (SELECT symbol, ts, score, CASE WHEN pct < 0.4 THEN least(c * 1.15::DOUBLE, 1) ELSE c END AS c FROM (
  SELECT *, CASE WHEN score > 0 THEN 0.5::DOUBLE ELSE {lin('rsi', 55, 80, 0.5, 1.0)} END * CASE WHEN pct > 0.75 THEN {lin('pct', 0.75, 1.0, 1.0, 0.3)} ELSE 1 END AS c FROM (
  SELECT *, -tanh(z / 1.6::DOUBLE) AS score FROM ft WHERE ready AND atr_pct > 1e-9 AND abs(spread / atr_pct) <= 1.2 AND abs(z) >= 0.7))) WHERE c >= 0.15)""",
    f"""bo AS (SELECT symbol, ts, 'breakout' AS agent, score, CASE WHEN (spread > 0) = (score > 0) THEN least(c + 0.15::DOUBLE, 1) ELSE c END AS confidence, 16 AS horizon FROM (
  SELECT *, CASE WHEN pos >= 0.9 THEN {lin('pos', 0.9, 1.0, 0.35, 1.0)} ELSE -0.35::DOUBLE END AS score, {lin('vz', -0.25, 2.0, 0.45, 1.0)} AS c FROM ft WHERE ready AND atr > 1e-12 AND close > 0 AND (dh - dl) / atr >= 2.5 AND (pos >= 0.9 OR pos <= 1 - 0.9::DOUBLE) AND vz >= -0.25))""",
    "pm AS MATERIALIZED (SELECT symbol, ts, CASE WHEN ready AND rv > 1e-9 THEN round(roc / rv, 9) END AS m FROM ft)",
    peers("pr", "pm"),
    f"""rs AS (SELECT symbol, ts, 'rel_strength' AS agent, score, c AS confidence, 32 AS horizon FROM (SELECT *, k / (cnt - 1)::DOUBLE * 2 - 1 AS score, least(CASE WHEN sp > 1e-12 THEN abs(m - mn) / sp ELSE 0 END * 2, 1) * {lin('sp', 0.02, 0.08, 0.0, 1.0)} AS c
  FROM pr WHERE cnt >= 3) WHERE c >= 0.15 AND abs(score) >= 0.2)""",
    "sg AS MATERIALIZED (SELECT * FROM mo UNION ALL SELECT * FROM mr UNION ALL SELECT * FROM bo UNION ALL SELECT * FROM rs)",
)


def features(spark: SparkSession, sf: str) -> DataFrame:
    df = I.feature_snapshot(bars(spark, sf), 24 * 365)
    return df.withColumn("_v", F.round("realized_vol", 8)).withColumn("vol_percentile", I.percentile_rank("_v", 200)).drop("_v")


@query(with_bars("SELECT symbol, ts, agent, round(score, 6) AS score, round(confidence, 6) AS confidence, horizon FROM sg", *FEATURES, recursive=True))
def agent_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = A.signals(features(spark, sf))
    return s.select("symbol", "ts", "agent", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "horizon")


APPETITE = f"CASE WHEN pct <= 0.7 THEN 1 ELSE {lin('pct', 0.70, 0.97, 1.0, 0.25)} END"


@query(with_bars(f"SELECT symbol, ts, round({APPETITE}, 6) AS appetite, CASE WHEN pct <= 0.7 THEN 'normal' WHEN pct < 0.97 THEN 'elevated' ELSE 'stressed' END AS label FROM ft WHERE ready", *FEATURES, recursive=True))
def regime_view(spark: SparkSession, sf: str) -> DataFrame:
    pct = F.col("vol_percentile")
    return features(spark, sf).where("ready").select("symbol", "ts", F.round(A.regime_appetite(pct), 6).alias("appetite"), A.regime_label(pct).alias("label"))


_BLEND = (
    *FEATURES,
    "bl AS (SELECT symbol, ts, sum(confidence * score) / sum(confidence) AS consensus, least(sum(confidence) / count(*), 1) AS conviction, count(*) AS agents FROM sg GROUP BY 1, 2 HAVING sum(confidence) > 1e-9)",
    f"""bw AS (SELECT bl.*, CASE WHEN abs(consensus) < 0.15 THEN 0 ELSE greatest(least(consensus * conviction * CASE WHEN rv <= 1e-6 THEN 0.25 ELSE least(greatest(0.2::DOUBLE / rv, 0.25), 2.5) END * {APPETITE}, 0.2), -0.2) END AS weight FROM bl JOIN ft ON ft.symbol = bl.symbol AND ft.ts = bl.ts)""",
)


def agent_state(df: DataFrame) -> DataFrame:
    return df.where("ready").select("symbol", "ts", "realized_vol", A.regime_appetite(F.col("vol_percentile")).alias("appetite"))


@query(with_bars("SELECT symbol, ts, round(consensus, 6) AS consensus, round(conviction, 6) AS conviction, agents, round(weight, 6) AS weight FROM bw", *_BLEND, recursive=True))
def blend(spark: SparkSession, sf: str) -> DataFrame:
    f = materialise(features(spark, sf), "barloom/features")  # signals and state both read them
    t = P.blend(A.signals(f), agent_state(f))
    return t.select("symbol", "ts", F.round("consensus", 6).alias("consensus"), F.round("conviction", 6).alias("conviction"), "agents", F.round("weight", 6).alias("weight"))


_ORDERS = "o AS (SELECT o_orderkey, o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, round((o_orderkey % 97 - 40) / 100.0::DOUBLE, 6) AS weight FROM orders)"


@query(
    f"""WITH {_ORDERS}, g AS (SELECT symbol, ts, round(avg(weight), 9) * 8 AS weight FROM o GROUP BY 1, 2), a AS (SELECT *, sum(abs(weight)) OVER (PARTITION BY ts) AS gr FROM g), n AS (SELECT symbol, ts, CASE WHEN gr > 1 THEN weight / gr ELSE weight END AS weight FROM a),
m AS (SELECT *, sum(weight) OVER (PARTITION BY ts) AS net FROM n), s AS (SELECT *, sum(CASE WHEN sign(weight) = sign(net) THEN abs(weight) ELSE 0 END) OVER (PARTITION BY ts) AS side FROM m)
SELECT symbol, ts, round(CASE WHEN abs(net) > 0.6 AND sign(weight) = sign(net) AND side > 1e-9 THEN weight * greatest(1 - (abs(net) - 0.6::DOUBLE) / side, 0) ELSE weight END, 6) AS weight FROM s"""
)
def exposure_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Caps over made-up targets: a weight for each order priority and month."""
    o = B.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.trunc("o_orderdate", "MM").cast("timestamp_ntz").alias("ts"), F.round((F.col("o_orderkey") % 97 - 40) / 100, 6).alias("weight"))
    t = o.groupBy("symbol", "ts").agg((F.round(F.avg("weight"), 9) * 8).alias("weight"))
    return P.exposure_caps(t).select("symbol", "ts", F.round("weight", 6).alias("weight"))


_EVIDENCE = """e AS (SELECT o_orderkey AS id, (o_orderkey % 11) / 10.0::DOUBLE AS conviction, (o_orderkey % 7) / 6.0::DOUBLE AS agreement, (o_orderkey % 9) / 8.0::DOUBLE AS coverage, (o_orderkey % 13) / 12.0::DOUBLE AS consensus, o_orderkey % 8 AS agents, o_orderkey % 2 = 0 AS aligned,
  o_orderkey % 3 = 0 AS has_stop, (o_orderkey % 17) / 2.0::DOUBLE AS reward_risk, (o_orderkey % 5) / 4.0::DOUBLE AS appetite, (o_orderkey % 19 - 9) / 40.0::DOUBLE AS funding, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS blockers, (o_orderkey % 23) / 500.0::DOUBLE AS stop_pct FROM orders),
c AS (SELECT *, (0.28::DOUBLE * conviction + 0.12::DOUBLE * agreement + 0.20::DOUBLE * least(consensus * least(1, sqrt(agents / 6.0::DOUBLE)), 1) + 0.16::DOUBLE * aligned::INTEGER + 0.12::DOUBLE * CASE WHEN has_stop THEN 0.6::DOUBLE + 0.4::DOUBLE * greatest(least((reward_risk - 3) / 3, 1), 0) ELSE 0 END
  + 0.07::DOUBLE * appetite + 0.05::DOUBLE * greatest(least(1 - greatest(funding, 0) / 0.2::DOUBLE, 1), 0)) * CASE WHEN blockers > 0 THEN 0.25 ELSE 1 END * CASE WHEN coverage < 0.5 THEN 0.5::DOUBLE + coverage ELSE 1 END AS score FROM e)"""


def evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    k = F.col("o_orderkey")
    o = B.read(spark, sf, "orders").select(
        k.alias("id"), (k % 11 / 10).alias("conviction"), (k % 7 / 6).alias("agreement"), (k % 9 / 8).alias("coverage"), (k % 13 / 12).alias("consensus"), (k % 8).alias("agents"), (k % 2 == 0).alias("aligned"),
        (k % 3 == 0).alias("has_stop"), (k % 17 / 2).alias("reward_risk"), (k % 5 / 4).alias("appetite"), ((k % 19 - 9) / 40).alias("funding"), F.when(k % 6 == 0, 1).otherwise(0).alias("blockers"), (k % 23 / 500).alias("stop_pct"),
    )
    return o, {c: F.col(c) for c in o.columns}


@query(f"WITH {_EVIDENCE} SELECT id, round(score + 1e-12, 9) AS score, CASE WHEN score >= 0.8 THEN 'very strong' WHEN score >= 0.65 THEN 'strong' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.35 THEN 'weak' ELSE 'not tradable' END AS band FROM c")
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    o, e = evidence(spark, sf)
    o = o.withColumn("score", P.confidence(e)[0])
    return o.select("id", F.round(F.col("score") + 1e-12, 9).alias("score"), P.confidence_band(F.col("score")).alias("band"))


@query(
    f"""WITH {_EVIDENCE}, l AS (SELECT id, 1 + pow(round(score, 9), 2.2::DOUBLE) * 99 AS asked, CASE WHEN stop_pct <= 0 THEN 1 ELSE greatest(0.55::DOUBLE / (stop_pct + 0.005::DOUBLE), 1) END AS room FROM c)
SELECT id, round(least(asked, room, 100), 6) AS leverage, CASE WHEN asked <= least(room, 100) THEN 'confidence' WHEN room <= 100 THEN 'liquidation' ELSE 'requested' END AS binding, round(greatest(1 / least(asked, room, 100) - 0.005::DOUBLE, 0), 6) AS liquidation_move FROM l"""
)
def leverage(spark: SparkSession, sf: str) -> DataFrame:
    o, e = evidence(spark, sf)
    x = o.select("id", P.leverage(F.round(P.confidence(e)[0], 9), F.col("stop_pct")).alias("x"))
    return x.select("id", F.round("x.leverage", 6).alias("leverage"), "x.binding", F.round("x.liquidation_move", 6).alias("liquidation_move"))


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_totalprice AS entry, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE o_totalprice * (1 - (o_orderkey % 15 - 5) / 100.0::DOUBLE) END AS stop, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice * (1 + (o_orderkey % 41 - 12) / 60.0::DOUBLE) END AS objective, 1000000.0::DOUBLE AS equity,
  (o_orderkey % 12) * 50000.0::DOUBLE AS invested, (o_orderkey % 9) * 26000.0::DOUBLE AS grp, 1 + o_orderkey % 4 AS leverage, 1 + o_orderkey % 5 AS layer, (o_orderkey % 8) / 6.0::DOUBLE AS conviction FROM orders),
q AS (SELECT *, abs(entry - stop) AS ru, stop < entry AS is_long, 0.5::DOUBLE * equity - invested AS room, 0.2::DOUBLE * equity - grp AS rg, entry / leverage AS unit FROM p),
r AS (SELECT *, abs(objective - entry) / nullif(ru, 0) AS rr, 0.005::DOUBLE * equity / nullif(ru, 0) AS x1, 0.1::DOUBLE * equity / unit AS x2, room / unit AS x3, rg / unit AS x4 FROM q),
s AS (SELECT *, least(x1, x2, x3, x4) * CASE WHEN layer > 1 THEN pow(0.5::DOUBLE, layer - 1) ELSE 1 END * least(conviction, 1) AS qty FROM r),
t AS (SELECT *, CASE WHEN entry <= 0 OR stop <= 0 OR ru <= 0 THEN 'no_stop' WHEN objective > 0 AND CASE WHEN is_long THEN objective <= entry ELSE objective >= entry END THEN 'stop_wrong_side' WHEN objective > 0 AND rr < 3 THEN 'reward_too_small' WHEN room <= 0 THEN 'portfolio_full' WHEN rg <= 0 THEN 'group_full' WHEN layer > 3 OR qty <= 0 THEN 'size_zero' WHEN qty * ru / equity > 0.05 + 1e-9 THEN 'risk_too_wide' END AS refusal FROM s)
SELECT id, round(CASE WHEN refusal IS NULL THEN qty ELSE 0 END, 6) AS qty, round(CASE WHEN refusal IS NULL THEN qty * ru ELSE 0 END, 4) AS risk, round(CASE WHEN objective > 0 AND ru > 0 THEN rr ELSE 0 END, 6) AS reward_risk,
  CASE WHEN refusal IS NULL THEN CASE WHEN x1 <= least(x2, x3, x4) THEN 'risk' WHEN x2 <= least(x3, x4) THEN 'market' WHEN x3 <= x4 THEN 'invested' ELSE 'group' END END AS binding, refusal FROM t"""
)
def size_plan(spark: SparkSession, sf: str) -> DataFrame:
    k, px = F.col("o_orderkey"), F.col("o_totalprice")
    p = {
        "entry": px, "stop": F.when(k % 29 == 0, 0.0).otherwise(px * (1 - (k % 15 - 5) / 100)), "objective": F.when(k % 10 == 0, 0.0).otherwise(px * (1 + (k % 41 - 12) / 60)), "equity": F.lit(1e6),
        "invested": k % 12 * 50000.0, "group_invested": k % 9 * 26000.0, "leverage": 1 + k % 4, "layer": 1 + k % 5, "conviction": k % 8 / 6,
    }
    o = B.read(spark, sf, "orders").withColumns({f"p_{c}": v for c, v in p.items()})
    x = o.select(k.alias("id"), P.size_plan({c: F.col(f"p_{c}") for c in p}).alias("x"))
    return x.select("id", F.round("x.qty", 6).alias("qty"), F.round("x.risk", 4).alias("risk"), F.round("x.reward_risk", 6).alias("reward_risk"), "x.binding", "x.refusal")


@query(
    """WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 101 - 50) * 900.0::DOUBLE AS n, (o_orderkey % 37 - 18) * 1200.0::DOUBLE AS pos, (o_orderkey % 23) * 5000.0::DOUBLE AS gross, (o_orderkey % 31 - 15) * 4500.0::DOUBLE AS net, 100000.0::DOUBLE AS equity, CASE WHEN o_orderkey % 40 = 0 THEN 'halted' WHEN o_orderkey % 25 = 0 THEN 'reduce_only' ELSE 'normal' END AS state, o_orderkey % 50 = 7 AS cooling FROM orders),
r AS (SELECT *, n * pos < 0 AND abs(n) <= abs(pos) AS reduces, least(0.35::DOUBLE * equity, greatest(0.2::DOUBLE * equity - abs(pos), 0), greatest(equity - gross, 0), greatest(0.6::DOUBLE * equity - sign(n) * net, 0)) AS room FROM o),
s AS (SELECT *, least(abs(n), room) AS size FROM r), t AS (SELECT *, CASE WHEN reduces THEN 'reducing' WHEN state <> 'normal' THEN state WHEN cooling THEN 'cooldown' WHEN size < 25 THEN 'too_small' WHEN size < abs(n) THEN 'resized' ELSE 'ok' END AS reason FROM s)
SELECT id, reason IN ('reducing', 'resized', 'ok') AS approved, round(CASE WHEN reason NOT IN ('reducing', 'resized', 'ok') THEN 0 WHEN reduces THEN n ELSE sign(n) * size END, 4) AS notional, reason FROM t"""
)
def risk_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = B.read(spark, sf, "orders").select(
        k.alias("id"), ((k % 101 - 50) * 900.0).alias("notional"), ((k % 37 - 18) * 1200.0).alias("position"), (k % 23 * 5000.0).alias("gross"), ((k % 31 - 15) * 4500.0).alias("net"), F.lit(1e5).alias("equity"),
        F.when(k % 40 == 0, "halted").when(k % 25 == 0, "reduce_only").otherwise("normal").alias("state"), (k % 50 == 7).alias("cooling"),
    )
    x = o.select("id", P.check_order({c: F.col(c) for c in o.columns}).alias("x"))
    return x.select("id", "x.approved", F.round("x.notional", 4).alias("notional"), "x.reason")
