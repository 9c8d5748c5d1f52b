"""Account guards, target filters, outside views, stops and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.operators import metrics as M
from barloom.operators import routing as R
from barloom.operators import stats as Q
from barloom.operators.multiframe import checklist
from barloom.operators.multiframe import verdict as verdict_of
from barloom.plans.q_metrics import rounded
from barloom.plans.q_patterns import evidence
from barloom.plans.q_recursions import DMI
from barloom.plans.q_stats import hurst_sql
from barloom.plans.q_windows import bars
from barloom.plans.registry import query
from barloom.plans.sql import BARS, with_bars


@query(
    with_bars(
        "SELECT symbol AS account, ts, state, round(-loss, 8) AS day_pnl, round(fall, 8) AS drawdown FROM g WHERE n > 0",
        "c AS MATERIALIZED (SELECT symbol, ts, n, date_trunc('day', ts) AS day, 2000 + close AS equity FROM b)",
        """g(symbol, n, ts, day, base, peak, state, loss, fall) AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS DATE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 'normal', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c
  UNION ALL
  SELECT symbol, n, ts, CAST(day AS DATE), b2, p2, CASE WHEN f >= 0.15 THEN 'halted' WHEN l >= 0.03 AND s2 = 'normal' THEN 'reduce_only' ELSE s2 END, l, f
  FROM (SELECT *, CASE WHEN b2 > 0 THEN (b2 - equity) / b2 ELSE 0 END AS l, CASE WHEN p2 > 0 THEN (p2 - equity) / p2 ELSE 0 END AS f FROM (
    SELECT s.symbol, s.n, s.ts, s.day, s.equity, CASE WHEN e.day IS NULL OR e.day <> s.day THEN s.equity ELSE e.base END AS b2, greatest(e.peak, s.equity) AS p2,
      CASE WHEN (e.day IS NULL OR e.day <> s.day) AND e.state = 'reduce_only' THEN 'normal' ELSE e.state END AS s2 FROM g e JOIN c s ON s.symbol = e.symbol AND s.n = e.n + 1))
)""",
        recursive=True,
    )
)
def account_guard(spark: SparkSession, sf: str) -> DataFrame:
    c = B.event_bars(spark, sf).select(F.col("symbol").alias("account"), "ts", (F.col("close") + 2000).alias("equity"))
    g = R.account_guard(c)
    return g.select("account", "ts", "state", F.round("day_pnl", 8).alias("day_pnl"), F.round("drawdown", 8).alias("drawdown"))


@query(
    """WITH t AS (SELECT o_orderkey AS symbol, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 41 - 20) / 100.0::DOUBLE END AS weight FROM orders), p AS (SELECT o_orderkey AS symbol, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 31 - 15) / 100.0::DOUBLE END AS held FROM orders),
j AS (SELECT coalesce(t.symbol, p.symbol) AS symbol, coalesce(held, 0) AS held, coalesce(weight, held, 0) AS want FROM t FULL JOIN p ON t.symbol = p.symbol)
SELECT symbol, held, CASE symbol % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN sign(want) <> sign(held) THEN 0 ELSE sign(held) * least(abs(want), abs(held)) END ELSE want END AS weight FROM j"""
)
def filter_targets(spark: SparkSession, sf: str) -> DataFrame:
    o, k = B.read(spark, sf, "orders"), F.col("o_orderkey")
    t = o.select(k.alias("symbol"), F.when(k % 3 != 0, (k % 41 - 20) / 100).alias("weight"))
    p = o.select(k.alias("symbol"), F.when(k % 4 != 0, (k % 31 - 15) / 100).alias("held"))
    state = F.when(F.col("symbol") % 3 == 0, "halted").when(F.col("symbol") % 3 == 1, "reduce_only").otherwise("normal")
    return R.filter_targets(t, p, state)


@query(
    """SELECT event_type AS symbol, ts, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, round(value / 100.0::DOUBLE * pow(0.5::DOUBLE, date_diff('microsecond', ts, TIMESTAMP '2024-02-15 00:00:00') / 3600000000.0::DOUBLE / 72.0::DOUBLE), 8) AS confidence
FROM events WHERE event_id % 4 <> 3 AND event_id % 3 <> 2 AND value <= 100 AND event_id % 10 <> 7"""
)
def outside_views(spark: SparkSession, sf: str) -> DataFrame:
    """Decayed views from JSON, some of it broken."""
    k = F.col("event_id")
    bias = F.when(k % 4 == 3, "sideways").when(k % 3 == 0, "bullish").when(k % 3 == 1, "bearish").otherwise("neutral")
    good = F.to_json(F.struct(F.col("event_type").alias("symbol"), bias.alias("bias"), (F.col("value") / 100).alias("confidence"), F.lit("r").alias("rationale")))
    e = B.read(spark, sf, "events").select("ts", F.when(k % 10 == 7, F.lit("{not json")).otherwise(good).alias("payload"))
    v = R.outside_views(e, F.lit("2024-02-15 00:00:00").cast("timestamp_ntz"), 72.0)
    return v.withColumn("confidence", F.round("confidence", 8))


@query(
    """WITH d AS (SELECT o_orderkey AS id, o_totalprice AS entry, o_totalprice * 0.01::DOUBLE AS atr, o_orderkey % 2 = 0 AS is_long, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * (1 + (o_orderkey % 13 - 6) / 100.0::DOUBLE) END AS ps, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice * (1 + (o_orderkey % 31 - 15) / 50.0::DOUBLE) END AS po,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * (1 + (o_orderkey % 17 - 8) / 100.0::DOUBLE) END AS level FROM orders),
s AS (SELECT *, CASE WHEN is_long THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side FROM d), l AS (SELECT *, level - side * 0.25::DOUBLE * atr AS lv, entry - side * 2 * atr AS plain FROM s),
c AS (SELECT *, CASE WHEN (entry - ps) * side > 0 THEN ps END AS a, CASE WHEN (entry - lv) * side > 0 THEN lv END AS b FROM l),
x AS (SELECT *, coalesce(a, b, plain) AS s0, CASE WHEN a IS NOT NULL THEN 'pattern' WHEN b IS NOT NULL THEN 'level' ELSE 'atr' END AS source FROM c),
y AS (SELECT *, CASE WHEN abs(entry - s0) < 2 * atr THEN plain ELSE s0 END AS stop FROM x), z AS (SELECT *, entry + side * 3 * abs(entry - stop) AS far FROM y)
SELECT id, round(stop + 1e-7, 4) AS stop, round(CASE WHEN (coalesce(po, far) - far) * side < 0 THEN far ELSE coalesce(po, far) END + 1e-7, 4) AS objective, source FROM z"""
)
def stop_and_target(spark: SparkSession, sf: str) -> DataFrame:
    k, px = F.col("o_orderkey"), F.col("o_totalprice")
    d = {
        "entry": px, "atr": px * 0.01, "is_long": k % 2 == 0, "pattern_stop": F.when(k % 3 == 0, px * (1 + (k % 13 - 6) / 100)), "pattern_objective": F.when(k % 6 == 0, px * (1 + (k % 31 - 15) / 50)),
        "level": F.when(k % 5 != 0, px * (1 + (k % 17 - 8) / 100)),
    }
    x = B.read(spark, sf, "orders").select(k.alias("id"), R.stop_and_target(d).alias("x"))
    return x.select("id", F.round(F.col("x.stop") + 1e-7, 4).alias("stop"), F.round(F.col("x.objective") + 1e-7, 4).alias("objective"), "x.source")


@query(
    """WITH RECURSIVE o AS MATERIALIZED (SELECT event_type AS symbol, ts, epoch_us(ts) / 1e6 AS px_at, CASE WHEN event_id % 29 = 0 THEN 'kill' WHEN event_id % 5 = 0 THEN 'fill' WHEN event_id % 7 < 2 THEN 'reject' ELSE 'submit' END AS event, event_id % 11 = 0 AS reduces, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
r(symbol, n, ts, working, since, rejects, blocked, action) AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), false, CAST(0 AS DOUBLE), 0, CAST(0 AS DOUBLE), '' FROM o
  UNION ALL
  SELECT symbol, n, ts, CASE WHEN event <> 'submit' THEN false WHEN act IN ('busy', 'held') THEN working ELSE true END, CASE WHEN act IN ('sent', 'replaced') THEN px_at ELSE since END,
    CASE WHEN event = 'fill' THEN 0 WHEN act = 'blocked' THEN 0 WHEN event = 'reject' THEN rejects + 1 ELSE rejects END, CASE WHEN act = 'blocked' THEN px_at + 300 ELSE blocked END, act
  FROM (SELECT s.symbol, s.n, s.ts, s.px_at, s.event, e.working, e.since, e.rejects, e.blocked, CASE WHEN s.event = 'kill' THEN 'cancelled' WHEN s.event = 'fill' THEN 'done' WHEN s.event = 'reject' AND e.rejects + 1 >= 3 THEN 'blocked' WHEN s.event = 'reject' THEN 'rejected'
    WHEN e.working AND s.px_at - e.since < 120 AND NOT s.reduces THEN 'busy' WHEN s.px_at < e.blocked AND NOT s.reduces THEN 'held' WHEN e.working THEN 'replaced' ELSE 'sent' END AS act FROM r e JOIN o s ON s.symbol = e.symbol AND s.n = e.n + 1)
) SELECT symbol, ts, action FROM r WHERE n > 0"""
)
def order_routing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    event = F.when(k % 29 == 0, "kill").when(k % 5 == 0, "fill").when(k % 7 < 2, "reject").otherwise("submit")
    o = B.read(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", event.alias("event"), (k % 11 == 0).alias("reduces"))
    return R.route(o, then=("event_id",))


@query(f"WITH {BARS}, g AS (SELECT symbol, arg_min(close, ts) AS a, arg_max(close, ts) AS z FROM b GROUP BY symbol) SELECT symbol, round(CASE WHEN a <= 0 THEN 1 ELSE least(greatest(z / a, 0), 1.5) END, 8) AS scalar FROM g")
def equity_scalar(spark: SparkSession, sf: str) -> DataFrame:
    g = B.event_bars(spark, sf).groupBy("symbol").agg(F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("z"))
    return g.select("symbol", F.round(R.equity_scalar(F.col("z"), F.nullif(F.col("a"), F.lit(0.0))), 8).alias("scalar"))


@query(
    with_bars(
        """SELECT symbol, round(hurst, 6) AS hurst, round(adx, 6) AS adx, CASE WHEN hurst > 0.55 AND adx >= 20 THEN 'trending' WHEN NOT hurst > 0.55 AND NOT adx >= 20 THEN 'ranging' ELSE 'mixed' END AS label,
  CASE WHEN hurst > 0.55 AND adx >= 20 THEN 0.85 WHEN NOT hurst > 0.55 AND NOT adx >= 20 THEN 0.75 ELSE 0.4 END::DOUBLE AS confidence FROM hu JOIN (SELECT symbol, arg_max(v, m) AS adx FROM ad GROUP BY symbol) USING (symbol)""",
        *DMI,
        *hurst_sql("close"),
        recursive=True,
    )
)
def trend_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Trending or ranging, from the Hurst exponent of closes and the last ADX."""
    b = I.dmi(bars(spark, sf))
    last = b.groupBy("symbol").agg(F.max_by("adx", "ts").alias("adx"))
    h = Q.hurst(b, "symbol", "ts", "close")
    return rounded(h.join(last, "symbol").withColumn("r", Q.trend_regime(F.col("hurst"), F.col("adx"))).select("symbol", "hurst", "adx", "r.*"))


@query()
def structure_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Opinions of the agents that read the checklist and the structure."""
    e = evidence(spark, sf)
    v = verdict_of(checklist(e), e.select("symbol", "ts", "ready", "permitted")).select("symbol", "ts", "bias", "score", "agreement", "conviction", "coverage", F.size("blockers").alias("n_blockers"))
    w = v.join(e, ["symbol", "ts"])
    return rounded(R.structure_signals(w))


@query()
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A simulated session's figures: its curve's and its trades'."""
    from barloom.plans.q_execution import simulate

    rows = simulate(spark, sf)
    curve = rows.where("event = 'equity'").groupBy("run_id", "ts").agg(F.max_by("equity", "symbol").alias("equity"))
    c = M.curve_metrics(curve, "run_id", "ts", 8760, 100_000.0)
    t = M.trade_metrics(rows.where("event = 'trade'"), "run_id")
    return rounded(c.join(t, "run_id", "left"))
