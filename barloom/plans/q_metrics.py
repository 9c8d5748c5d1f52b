"""Performance, edge and perpetual-futures statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.operators import metrics as M
from barloom.plans.q_windows import show
from barloom.plans.registry import query
from barloom.plans.sql import BARS, ORDER


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def curve(spark: SparkSession, sf: str) -> DataFrame:
    """An equity curve for each symbol: a start of 1000 and the closes."""
    return B.event_bars(spark, sf).select("symbol", "ts", (F.col("close") + 1000).alias("equity"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Closed trades from consecutive orders of a customer: bought at one total and sold at the next, a tenth of it at risk."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = B.read(spark, sf, "orders").withColumn("nxt", F.lead("o_totalprice").over(w)).where(F.col("nxt").isNotNull())
    risk = F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.round(F.col("o_totalprice") * 0.1, 6))
    return o.select(F.col("o_orderpriority").alias("symbol"), "o_orderdate", "o_orderkey", F.round(F.col("nxt") - F.col("o_totalprice"), 6).alias("pnl"), risk.alias("risk"))


CURVE = f"""{BARS}, c AS (SELECT symbol, ts, n, close + 1000 AS equity FROM b), r AS (SELECT *, equity / lag(equity) OVER ({ORDER}) - 1 AS ret, max(equity) OVER ({ORDER}) AS peak FROM c),
d AS (SELECT *, (peak - equity) / peak AS dd, n - max(CASE WHEN equity = peak AND (n = 1 OR equity > prev_peak) THEN n END) OVER ({ORDER}) AS down
  FROM (SELECT *, lag(peak) OVER ({ORDER}) AS prev_peak FROM r))"""
TRADES = """t AS (SELECT o_orderpriority AS symbol, o_orderdate, o_orderkey, round(nxt - o_totalprice, 6) AS pnl, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE round(o_totalprice * 0.1::DOUBLE, 6) END AS risk
  FROM (SELECT *, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL)"""


@query(f"WITH {CURVE} SELECT symbol, ts, round(ret, 8) AS ret FROM r")
def bar_returns(spark: SparkSession, sf: str) -> DataFrame:
    return show(M.bar_returns(curve(spark, sf), "symbol", "ts"), "ret", digits=8)


@query(f"WITH {CURVE} SELECT symbol, ts, round(peak, 6) AS peak, round(dd, 8) AS drawdown, CAST(down AS INTEGER) AS bars_down FROM d")
def drawdown_series(spark: SparkSession, sf: str) -> DataFrame:
    d = M.drawdowns(curve(spark, sf), "symbol", "ts")
    return d.select("symbol", "ts", F.round("peak", 6).alias("peak"), F.round("drawdown", 8).alias("drawdown"), "bars_down")


@query(
    f"""WITH {CURVE}, g AS (SELECT symbol, count(*) AS bars, arg_min(equity, ts) AS first_equity, arg_max(equity, ts) AS final_equity, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS ds,
  count(ret) AS k, max(dd) AS max_drawdown FROM d GROUP BY symbol), x AS (SELECT g.*, (SELECT arg_min(down, n) FROM d WHERE d.symbol = g.symbol AND d.dd = g.max_drawdown) AS max_drawdown_bars, exp(ln(final_equity / first_equity) / (k / 8760.0::DOUBLE)) - 1 AS ann FROM g)
SELECT symbol, bars, round(first_equity, 6) AS first_equity, round(final_equity, 6) AS final_equity, round(final_equity / first_equity - 1, 6) AS total_return, round(s * sqrt(8760), 6) AS volatility, round(m / s * sqrt(8760), 6) AS sharpe,
  round(m / ds * sqrt(8760), 6) AS sortino, round(ann, 6) AS annualised, round(max_drawdown, 6) AS max_drawdown, CAST(max_drawdown_bars AS INTEGER) AS max_drawdown_bars, round(ann / max_drawdown, 6) AS calmar FROM x"""
)
def curve_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.curve_metrics(curve(spark, sf), "symbol", "ts", 8760))


@query(
    f"""WITH {TRADES}, g AS (SELECT symbol, count(*) AS trades, CAST(count_if(pnl > 0) AS BIGINT) AS wins, CAST(count_if(pnl <= 0) AS BIGINT) AS losses, sum(CASE WHEN pnl > 0 THEN pnl END) AS gw, abs(sum(CASE WHEN pnl <= 0 THEN pnl END)) AS gl, avg(pnl) AS e, max(pnl) AS lw, min(pnl) AS ll,
  avg(CASE WHEN risk > 1e-12 THEN pnl / risk END) AS mr, sum(CASE WHEN risk > 1e-12 THEN pnl END) / sum(CASE WHEN risk > 1e-12 THEN risk END) AS rw, median(CASE WHEN risk > 1e-12 THEN risk END) AS md, min(CASE WHEN risk > 1e-12 THEN risk END) AS mn,
  max(CASE WHEN risk > 1e-12 THEN risk END) AS mx, CAST(count_if(NOT risk > 1e-12) AS BIGINT) AS nr FROM t GROUP BY symbol)
SELECT symbol, trades, wins, losses, round(gw, 4) AS gross_win, round(gl, 4) AS gross_loss, round(e, 4) AS expectancy, round(lw, 4) AS largest_win, round(ll, 4) AS largest_loss, round(mr, 6) AS mean_r, round(rw, 6) AS risk_weighted_r, round(md, 4) AS median_risk,
  round(mn, 4) AS min_risk, round(mx, 4) AS max_risk, nr AS trades_without_risk, round(wins / trades, 6) AS hit_rate, round(gw / gl, 6) AS profit_factor, round(gw / wins, 4) AS avg_win, round(-gl / losses, 4) AS avg_loss, round(mx / mn, 4) AS risk_dispersion FROM g"""
)
def trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g = M.trade_metrics(trades(spark, sf), "symbol")
    six = {"mean_r", "risk_weighted_r", "hit_rate", "profit_factor"}
    return g.select(*[F.round(c, 6 if c in six else 4).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])


EDGE = f"""{TRADES}, q AS (SELECT symbol, o_orderdate, o_orderkey, round(pnl / risk, 8) AS r FROM t WHERE risk > 0),
i AS (SELECT *, r > 0 AS won, row_number() OVER (PARTITION BY symbol ORDER BY o_orderdate, o_orderkey) AS n, row_number() OVER (PARTITION BY symbol ORDER BY o_orderdate, o_orderkey) - row_number() OVER (PARTITION BY symbol, r > 0 ORDER BY o_orderdate, o_orderkey) AS g FROM q),
runs AS (SELECT symbol, won, g, count(*) AS k, max(n) AS last, sum(r) AS s FROM i GROUP BY 1, 2, 3),
e AS (SELECT symbol, CAST(sum(k) AS BIGINT) AS count, CAST(coalesce(sum(CASE WHEN won THEN k END), 0) AS BIGINT) AS wins, CAST(coalesce(sum(CASE WHEN NOT won THEN k END), 0) AS BIGINT) AS losses, sum(s) AS total_r, coalesce(sum(CASE WHEN won THEN s END), 0) AS win_r, coalesce(sum(CASE WHEN NOT won THEN s END), 0) AS loss_r,
  coalesce(max(CASE WHEN won THEN k END), 0) AS longest_win_streak, coalesce(max(CASE WHEN NOT won THEN k END), 0) AS longest_loss_streak, arg_max(CASE WHEN won THEN k ELSE -k END, last) AS current_streak FROM runs GROUP BY symbol),
f AS (SELECT *, wins / count AS p, (win_r / wins) / abs(loss_r / losses) AS payoff FROM e),
w AS (SELECT *, 1 + 3.8416::DOUBLE / count AS below, p + 3.8416::DOUBLE / (2 * count) AS middle, 1.96::DOUBLE * sqrt(p * (1 - p) / count + 3.8416::DOUBLE / (4 * count * count)) AS margin FROM f)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).where("risk > 0").withColumn("r", F.round(F.col("pnl") / F.col("risk"), 8))


@query(
    f"""WITH {EDGE} SELECT symbol, count, wins, losses, round(total_r, 6) AS total_r, round(win_r, 6) AS win_r, round(loss_r, 6) AS loss_r, longest_win_streak, longest_loss_streak, current_streak, round(p, 6) AS win_rate, round(total_r / count, 6) AS expectancy_r,
  round(win_r / wins, 6) AS avg_win_r, round(loss_r / losses, 6) AS avg_loss_r, count >= 30 AS reliable, round(payoff, 6) AS payoff, round(1 / (1 + payoff), 6) AS breakeven, round(p - 1 / (1 + payoff), 6) AS edge_margin,
  round((middle - margin) / below, 6) AS wilson_low, round((middle + margin) / below, 6) AS wilson_high FROM w"""
)
def edge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.edge_stats(outcomes(spark, sf), "symbol", ["o_orderdate", "o_orderkey"]))


@query(
    f"""WITH {EDGE}, k AS (SELECT symbol, p, payoff, count, longest_loss_streak, greatest((middle - margin) / below - (1 - (middle - margin) / below) / payoff, 0) AS full_kelly FROM w)
SELECT symbol, round(full_kelly, 6) AS full_kelly, round(CASE WHEN count < 30 THEN 0.05 WHEN full_kelly <= 0 THEN 0 ELSE least(full_kelly * 0.25::DOUBLE, 0.05::DOUBLE) END, 6) AS risk_share,
  CASE WHEN count < 30 THEN 'sample' WHEN full_kelly <= 0 THEN 'no_edge' WHEN full_kelly * 0.25::DOUBLE < 0.05 THEN 'kelly' ELSE 'cap' END AS binding, round(p * ln(1 + 0.1::DOUBLE * payoff) + (1 - p) * ln(0.9::DOUBLE), 8) AS growth,
  round(1 - pow(1 - pow(1 - p, longest_loss_streak), count - longest_loss_streak + 1), 8) AS streak_chance, greatest(CAST(floor(ln(count) / ln(1 / (1 - p))) AS INTEGER), 1) AS worst_expected FROM k"""
)
def kelly_sizing(spark: SparkSession, sf: str) -> DataFrame:
    s = M.kelly_risk(M.edge_stats(outcomes(spark, sf), "symbol", ["o_orderdate", "o_orderkey"]))
    return s.select(
        "symbol", F.round("full_kelly", 6).alias("full_kelly"), F.round("risk_share", 6).alias("risk_share"), "binding", F.round(M.growth_rate(F.col("win_rate"), F.col("payoff"), 0.1), 8).alias("growth"),
        F.round(M.streak_probability(F.col("longest_loss_streak"), F.col("win_rate"), F.col("count")), 8).alias("streak_chance"), M.expected_worst_streak(F.col("win_rate"), F.col("count")).alias("worst_expected"),
    )


@query("SELECT reason, count(*) AS n FROM (SELECT unnest([event_type, CASE WHEN value < 5 THEN 'below minimum' END, CASE WHEN value > 100 THEN 'above limit' END]) AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 6")
def rejections_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The six most frequent reasons."""
    e = B.read(spark, sf, "events")
    reasons = F.array(F.col("event_type"), F.when(F.col("value") < 5, "below minimum"), F.when(F.col("value") > 100, "above limit"))
    r = e.select(F.explode(F.array_compact(reasons)).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(6)


@query(
    """WITH f AS (SELECT event_type AS symbol, ts, (value - 35) / 100000.0::DOUBLE AS rate FROM events), g AS (SELECT symbol, count(*) AS n, avg(rate) AS m, median(rate) AS md, avg(CASE WHEN rate > 0 THEN 1.0 ELSE 0.0 END) AS pos, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY symbol)
SELECT symbol, n, round(m, 10) AS mean_rate, round(md, 10) AS median_rate, round(pos, 6) AS positive_share, round(m * 1095, 8) AS annualised, first_ts, last_ts, pos >= 0.7 AND m * 1095 >= 0.05 AS crowded_long, pos <= 0.3 AND m * 1095 <= -0.05 AS crowded_short FROM g"""
)
def funding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Funding rates of each symbol, three a day; a side is crowded if it pays mostly and much."""
    f = B.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", ((F.col("value") - 35) / 100000).alias("rate"))
    g = f.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rate").alias("m"), F.median("rate").alias("md"), F.avg(F.when(F.col("rate") > 0, 1.0).otherwise(0.0)).alias("pos"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    year = F.col("m") * 1095
    return g.select(
        "symbol", "n", F.round("m", 10).alias("mean_rate"), F.round("md", 10).alias("median_rate"), F.round("pos", 6).alias("positive_share"), F.round(year, 8).alias("annualised"), "first_ts", "last_ts",
        ((F.col("pos") >= 0.7) & (year >= 0.05)).alias("crowded_long"), ((F.col("pos") <= 0.3) & (year <= -0.05)).alias("crowded_short"),
    )


@query("SELECT symbol, ts, rate, CAST(k AS INTEGER) AS k FROM (SELECT event_type AS symbol, ts, round((value - 35) / 100000.0::DOUBLE, 10) AS rate, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 35) DESC, event_id) AS k FROM events) WHERE k <= 20")
def funding_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest settlements of each symbol, by size."""
    w = Window.partitionBy("event_type").orderBy(F.desc(F.abs(F.col("value") - 35)), "event_id")
    e = B.read(spark, sf, "events").withColumn("k", F.row_number().over(w)).where("k <= 20")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.round((F.col("value") - 35) / 100000, 10).alias("rate"), "k")


@query(
    f"""WITH {BARS}, g AS (SELECT symbol, arg_min(close, ts) AS p0, arg_max(close, ts) AS p1, arg_min(volume, ts) AS o0, arg_max(volume, ts) AS o1 FROM b GROUP BY symbol)
SELECT symbol, CASE WHEN p1 > p0 AND o1 > o0 THEN 'new_money_long' WHEN p1 > p0 AND o1 < o0 THEN 'short_covering' WHEN p1 < p0 AND o1 > o0 THEN 'new_money_short' WHEN p1 < p0 AND o1 < o0 THEN 'long_liquidation' ELSE 'unknown' END AS signal FROM g"""
)
def oi_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Price and open interest from first to last."""
    b = B.event_bars(spark, sf).groupBy("symbol").agg(F.min_by("close", "ts").alias("p0"), F.max_by("close", "ts").alias("p1"), F.min_by("volume", "ts").alias("o0"), F.max_by("volume", "ts").alias("o1"))
    up, down, more, less = F.col("p1") > F.col("p0"), F.col("p1") < F.col("p0"), F.col("o1") > F.col("o0"), F.col("o1") < F.col("o0")
    label = F.when(up & more, "new_money_long").when(up & less, "short_covering").when(down & more, "new_money_short").when(down & less, "long_liquidation").otherwise("unknown")
    return b.select("symbol", label.alias("signal"))


@query(
    f"""WITH {TRADES} SELECT symbol, o_orderkey, pnl, r, CAST(k AS INTEGER) AS k FROM (SELECT symbol, o_orderkey, pnl, round(pnl / risk, 6) AS r, row_number() OVER (ORDER BY abs(round(pnl / risk, 6)) DESC, o_orderkey) AS k FROM t WHERE risk > 0) WHERE k <= 25"""
)
def largest_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 trades with the largest R, by size."""
    t = trades(spark, sf).where("risk > 0").select("symbol", "o_orderkey", "pnl", F.round(F.col("pnl") / F.col("risk"), 6).alias("r"))
    top = t.orderBy(F.desc(F.abs("r")), "o_orderkey").limit(25)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "o_orderkey")))


@query("SELECT p_brand AS tag, count(*) AS fills, round(sum(l_extendedprice * (1 - l_discount)), 2) AS realised FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def attribution_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    li, p = B.read(spark, sf, "lineitem"), B.read(spark, sf, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("p_brand").alias("tag")).agg(F.count(F.lit(1)).alias("fills"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("realised"))


@query("SELECT event_type AS principle, CASE WHEN value > 60 THEN 'violation' WHEN value > 30 THEN 'warning' ELSE 'note' END AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def adherence_counts(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("value") > 60, "violation").when(F.col("value") > 30, "warning").otherwise("note")
    return B.read(spark, sf, "events").groupBy(F.col("event_type").alias("principle"), severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
