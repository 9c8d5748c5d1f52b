"""Execution, wave counts, levels and trendlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.operators import agents as A
from barloom.operators import elliott as W
from barloom.operators import execution as X
from barloom.operators import lines as L
from barloom.operators import portfolio as P
from barloom.plans.q_metrics import rounded
from barloom.plans.q_structure import pivots
from barloom.plans.q_trading import agent_state, features
from barloom.plans.q_windows import bars
from barloom.plans.registry import query
from barloom.session import materialise

FILLS = """f AS MATERIALIZED (SELECT o_orderpriority AS symbol, o_orderkey, o_orderkey AS ts, round(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (1 + o_orderkey % 5) * CASE WHEN o_orderkey % 11 = 0 THEN -4 ELSE 1 END, 6) AS signed, o_totalprice AS price,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders)"""


def fills(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    side = F.when(k % 3 == 0, -1.0).otherwise(1.0) * (1 + k % 5) * F.when(k % 11 == 0, -4.0).otherwise(1.0)
    return B.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), k.alias("ts"), side.alias("signed"), F.col("o_totalprice").alias("price"))


@query(
    f"""WITH RECURSIVE {FILLS}, p(symbol, n, ts, qty, avg, realised, gain) AS (
  SELECT symbol, n, ts, CAST(signed AS DOUBLE), CAST(price AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM f WHERE n = 1
  UNION ALL
  SELECT symbol, n, ts, CASE WHEN abs(qty + signed) < 1e-12 THEN 0 ELSE qty + signed END,
    CASE WHEN abs(qty) < 1e-12 THEN price WHEN (qty > 0) = (signed > 0) THEN (avg * qty + price * signed) / (qty + signed) WHEN abs(qty + signed) < 1e-12 THEN 0 WHEN (qty + signed > 0) <> (qty > 0) THEN price ELSE avg END, realised + g, g
  FROM (SELECT s.symbol, s.n, s.ts, e.qty, e.avg, e.realised, s.signed, s.price, CASE WHEN abs(e.qty) >= 1e-12 AND (e.qty > 0) <> (s.signed > 0) THEN (s.price - e.avg) * least(abs(s.signed), abs(e.qty)) * sign(e.qty) ELSE 0 END AS g FROM p e JOIN f s ON s.symbol = e.symbol AND s.n = e.n + 1)
) SELECT symbol, ts, qty, round(avg + 1e-7, 4) AS avg_price, round(realised + 1e-6, 2) AS realised FROM p"""
)
def position_fold(spark: SparkSession, sf: str) -> DataFrame:
    p = X.positions(fills(spark, sf))
    return p.select("symbol", "ts", "qty", F.round(F.col("avg_price") + 1e-7, 4).alias("avg_price"), F.round(F.col("realised") + 1e-6, 2).alias("realised"))


@query(
    f"""WITH {FILLS} SELECT symbol, ts, CAST(sum(signed) OVER w AS DOUBLE) AS qty, round(1000000 - sum(signed * price + abs(signed) * price / 10000.0::DOUBLE) OVER w, 2) AS cash, round(1000000 - sum(signed * price + abs(signed) * price / 10000.0::DOUBLE) OVER w + sum(signed) OVER w * price, 2) AS equity FROM f
WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def cash_ledger(spark: SparkSession, sf: str) -> DataFrame:
    led = X.ledger(fills(spark, sf), 1e6, ["ts"])
    return led.select("symbol", "ts", "qty", F.round("cash", 2).alias("cash"), F.round(F.col("cash") + F.col("qty") * F.col("price"), 2).alias("equity"))


@query()
def elliott_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.elliott_best(W.elliott_counts(pivots(spark, sf))))


@query()
def levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.levels(I.atr(bars(spark, sf)), pivots(spark, sf)))


@query()
def trendlines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.trendlines(I.atr(bars(spark, sf)), pivots(spark, sf)))


@query()
def channels(spark: SparkSession, sf: str) -> DataFrame:
    p = pivots(spark, sf)
    return rounded(L.channels(L.trendlines(I.atr(bars(spark, sf)), p), p))


@query()
def simulate(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, without and with leverage, of what the agents think, blended and capped over all symbols."""
    f = materialise(features(spark, sf), "barloom/features")
    t = P.exposure_caps(P.blend(A.signals(f), agent_state(f)))
    df = f.select("symbol", "ts", "open", "high", "low", "close", "volume", "atr").join(t.select("symbol", "ts", "weight"), ["symbol", "ts"], "left")
    df = df.where("atr IS NOT NULL").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    runs = F.explode(F.array(F.struct(F.lit("x1").alias("run_id"), F.lit(1.0).alias("leverage")), F.struct(F.lit("x2").alias("run_id"), F.lit(2.0).alias("leverage"))))
    return rounded(X.simulate(df.select("*", runs.alias("r")).select("*", "r.*")))
