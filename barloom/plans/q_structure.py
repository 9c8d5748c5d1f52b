"""Swing structure: SAR, pivots, legs, trend, retracements, divergence, gaps, reversal bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.operators import kernels as K
from barloom.operators import structure as T
from barloom.plans.q_metrics import rounded
from barloom.plans.q_windows import bars, show
from barloom.plans.registry import query
from barloom.plans.sql import ORDER, TRUE_RANGE, smoothing, with_bars, w

SAR = """sar(symbol, n, ts, sar, ep, af, up, h1, l1, h2, l2, flipped) AS (
  SELECT symbol, n, ts, low, high, CAST(0.02 AS DOUBLE), true, high, low, high, low, false FROM b WHERE n = 1
  UNION ALL
  SELECT symbol, n, ts, CASE WHEN hit THEN ep ELSE x END, CASE WHEN hit THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
    CASE WHEN hit THEN 0.02::DOUBLE WHEN up AND high > ep THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) WHEN NOT up AND low < ep THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END, CASE WHEN hit THEN NOT up ELSE up END, high, low, h1, l1, hit
  FROM (SELECT *, CASE WHEN up THEN low <= x ELSE high >= x END AS hit FROM (
    SELECT s.symbol, s.n, s.ts, s.high, s.low, e.ep, e.af, e.up, e.h1, e.l1, CASE WHEN e.up THEN least(e.sar + e.af * (e.ep - e.sar), e.l1, e.l2) ELSE greatest(e.sar + e.af * (e.ep - e.sar), e.h1, e.h2) END AS x
    FROM sar e JOIN b s ON s.symbol = e.symbol AND s.n = e.n + 1))
)"""

SWINGS = (
    TRUE_RANGE,
    smoothing("a", "tr", "t", 14, "1.0::DOUBLE / 14"),
    "z AS MATERIALIZED (SELECT b.*, a.v AS atr, greatest(1.5::DOUBLE * a.v, 0.002::DOUBLE * greatest(b.close, 1e-9)) AS gap FROM b JOIN a ON a.symbol = b.symbol AND a.n = b.n)",
    """sw(symbol, n, seek, price, px_at, vol, hi, hi_at, hi_vol, lo, lo_at, lo_vol, p_kind, p_price, p_at, p_vol, p_atr) AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT), 0, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE),
    CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM z
  UNION ALL
  SELECT symbol, n, CASE WHEN ev = 'peak' THEN -1 WHEN ev = 'trough' THEN 1 ELSE seek END,
    CASE WHEN ev = 'peak' THEN low WHEN ev = 'trough' THEN high WHEN ride THEN CASE WHEN seek > 0 THEN high ELSE low END ELSE price END, CASE WHEN ev IS NOT NULL OR ride THEN n - 1 ELSE px_at END, CASE WHEN ev IS NOT NULL OR ride THEN volume ELSE vol END,
    hi2, hi_at2, hi_vol2, lo2, lo_at2, lo_vol2, ev, CASE WHEN seek <> 0 THEN price WHEN ev = 'peak' THEN hi2 ELSE lo2 END, CASE WHEN seek <> 0 THEN px_at WHEN ev = 'peak' THEN hi_at2 ELSE lo_at2 END,
    CASE WHEN seek <> 0 THEN vol WHEN ev = 'peak' THEN hi_vol2 ELSE lo_vol2 END, CASE WHEN atr > 0 THEN gap / atr ELSE 0 END
  FROM (SELECT *, CASE WHEN gap <= 0 OR fresh THEN NULL WHEN seek = 0 AND hi2 - low >= gap AND hi_at2 <= lo_at2 THEN 'peak' WHEN seek = 0 AND high - lo2 >= gap THEN 'trough' WHEN seek = 0 AND hi2 - low >= gap THEN 'peak'
      WHEN seek > 0 AND NOT ride AND price - low >= gap THEN 'peak' WHEN seek < 0 AND NOT ride AND high - price >= gap THEN 'trough' END AS ev
    FROM (SELECT s.symbol, s.n, s.high, s.low, s.volume, s.atr, s.gap, e.seek, e.price, e.px_at, e.vol, e.seek = 0 AND e.hi IS NULL AS fresh,
      s.gap > 0 AND ((e.seek > 0 AND s.high > e.price) OR (e.seek < 0 AND s.low < e.price)) AS ride,
      CASE WHEN s.gap <= 0 OR e.seek <> 0 THEN e.hi WHEN e.hi IS NULL THEN s.close WHEN s.high > e.hi THEN s.high ELSE e.hi END AS hi2, CASE WHEN s.gap <= 0 OR e.seek <> 0 THEN e.hi_at WHEN e.hi IS NULL OR s.high > e.hi THEN s.n - 1 ELSE e.hi_at END AS hi_at2,
      CASE WHEN s.gap <= 0 OR e.seek <> 0 THEN e.hi_vol WHEN e.hi IS NULL OR s.high > e.hi THEN s.volume ELSE e.hi_vol END AS hi_vol2,
      CASE WHEN s.gap <= 0 OR e.seek <> 0 THEN e.lo WHEN e.lo IS NULL THEN s.close WHEN s.low < e.lo THEN s.low ELSE e.lo END AS lo2, CASE WHEN s.gap <= 0 OR e.seek <> 0 THEN e.lo_at WHEN e.lo IS NULL OR s.low < e.lo THEN s.n - 1 ELSE e.lo_at END AS lo_at2,
      CASE WHEN s.gap <= 0 OR e.seek <> 0 THEN e.lo_vol WHEN e.lo IS NULL OR s.low < e.lo THEN s.volume ELSE e.lo_vol END AS lo_vol2
    FROM sw e JOIN z s ON s.symbol = e.symbol AND s.n = e.n + 1))
)""",
    "pv AS MATERIALIZED (SELECT symbol, p_kind AS kind, p_price AS price, p_at AS px_at, n - 1 AS known, p_vol AS vol, p_atr FROM sw WHERE p_kind IS NOT NULL)",
)


def pivots(spark: SparkSession, sf: str) -> DataFrame:
    return K.swings(I.atr(bars(spark, sf)))


@query(with_bars("SELECT symbol, ts, round(sar, 6) AS sar, up AS is_long, flipped FROM sar", SAR, recursive=True))
def parabolic_sar(spark: SparkSession, sf: str) -> DataFrame:
    return show(K.parabolic_sar(bars(spark, sf)), "sar", "is_long", "flipped")


@query(with_bars("SELECT pv.symbol, b.ts, CAST(px_at AS INTEGER) AS index, price, kind, CAST(known AS INTEGER) AS confirmed_index, vol AS volume, round(p_atr, 6) AS confirm_atr FROM pv JOIN b ON b.symbol = pv.symbol AND b.n = pv.known + 1", *SWINGS, recursive=True))
def swings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pivots(spark, sf))


@query(
    with_bars(
        """SELECT symbol, known AS confirmed_index, price > p AS is_up, round(abs(price - p), 6) AS height, px_at - pr_at AS bars, round(CASE WHEN p <= 0 THEN 0 ELSE (price - p) / p END, 6) AS pct
FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY known) AS p, lag(px_at) OVER (PARTITION BY symbol ORDER BY known) AS pr_at FROM pv) WHERE p IS NOT NULL""",
        *SWINGS,
        recursive=True,
    )
)
def legs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.legs(pivots(spark, sf)).select("symbol", F.col("confirmed_index").cast("long").alias("confirmed_index"), "is_up", "height", F.col("bars").cast("long").alias("bars"), "pct"))


TREND = (
    *SWINGS,
    """k2 AS (SELECT symbol, known, kind, price, px_at, lag(price) OVER (PARTITION BY symbol, kind ORDER BY known) AS prev, lag(px_at) OVER (PARTITION BY symbol, kind ORDER BY known) AS pr_at, row_number() OVER (PARTITION BY symbol ORDER BY known) AS used FROM pv)""",
    f"""st AS (SELECT b.symbol, b.ts, b.n, b.close, last_value(CASE WHEN kind = 'peak' THEN prev END IGNORE NULLS) OVER o AS pp, last_value(CASE WHEN kind = 'peak' AND prev IS NOT NULL THEN price END IGNORE NULLS) OVER o AS pl, last_value(CASE WHEN kind = 'trough' THEN prev END IGNORE NULLS) OVER o AS tp,
  last_value(CASE WHEN kind = 'trough' AND prev IS NOT NULL THEN price END IGNORE NULLS) OVER o AS tl, coalesce(last_value(used IGNORE NULLS) OVER o, 0) AS used
  FROM b LEFT JOIN k2 ON k2.symbol = b.symbol AND k2.known = b.n - 1 WINDOW o AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    """tc AS (SELECT *, CASE WHEN pp <= 0 OR abs((pl - pp) / pp) <= 0.0025 THEN 0 ELSE sign(pl - pp) END AS pr, CASE WHEN tp <= 0 OR abs((tl - tp) / tp) <= 0.0025 THEN 0 ELSE sign(tl - tp) END AS tr, pp IS NOT NULL AND tp IS NOT NULL AS ok FROM st)""",
    """td AS (SELECT *, CASE WHEN NOT ok THEN 'unknown' WHEN pr > 0 AND tr > 0 THEN 'up' WHEN pr < 0 AND tr < 0 THEN 'down' ELSE 'sideways' END AS direction FROM tc)""",
    """te AS (SELECT *, CASE WHEN direction = 'up' AND close < tl THEN 'support_broken' WHEN direction = 'down' AND close > pl THEN 'support_broken' WHEN direction = 'sideways' AND (close > pl OR close < tl) THEN 'support_broken' ELSE 'intact' END AS health FROM td)""",
)


@query(
    with_bars(
        """SELECT symbol, ts, direction, health, CAST(used AS INTEGER) AS pivots_used, round(CASE WHEN direction = 'unknown' THEN 0 ELSE CASE WHEN health = 'intact' THEN 1.0 ELSE 0.2 END * CASE WHEN direction = 'sideways' THEN 0.5 ELSE 1.0 END * (0.5::DOUBLE + 0.5::DOUBLE * least(1, least(used, 200) / 4.0::DOUBLE)) END, 6) AS confidence FROM te""",
        *TREND,
        recursive=True,
    )
)
def dow_trend(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    t = T.dow_trend(b, K.swings(I.atr(b)))
    return show(t, "direction", "health", "pivots_used", "confidence")


@query(
    with_bars(
        """SELECT symbol, known AS confirmed_index, round(price - (price - p) / 3, 6) AS r33, round(price - (price - p) * 0.382::DOUBLE, 6) AS r38, round(price - (price - p) * 0.5::DOUBLE, 6) AS r50, round(price - (price - p) * 0.618::DOUBLE, 6) AS r62, round(price - (price - p) * 2 / 3, 6) AS r67,
  round(price + (price - p), 6) AS fib_1000, round(price + (price - p) * 1.618::DOUBLE, 6) AS fib_1618
FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY known) AS p FROM pv) WHERE p IS NOT NULL""",
        *SWINGS,
        recursive=True,
    )
)
def retracements(spark: SparkSession, sf: str) -> DataFrame:
    r = T.retracements(pivots(spark, sf))
    return rounded(r.select("symbol", F.col("confirmed_index").cast("long").alias("confirmed_index"), "r33", "r38", "r50", "r62", "r67", "fib_1000", "fib_1618"))


_GAPS = (
    TRUE_RANGE,
    smoothing("a", "tr", "t", 14, "1.0::DOUBLE / 14"),
    f"""g0 AS (SELECT b.symbol, b.ts, b.n, b.high, b.low, b.volume, a.v AS atr, lag(b.high) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS ph, lag(b.low) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS pl, avg(b.volume) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS av
  FROM b JOIN a ON a.symbol = b.symbol AND a.n = b.n)""",
    """g AS MATERIALIZED (SELECT symbol, ts, n, low > ph AS up, CASE WHEN low > ph THEN ph ELSE high END AS lo, CASE WHEN low > ph THEN low ELSE pl END AS hi, CASE WHEN av > 0 THEN volume / av ELSE 1 END AS vr FROM g0
  WHERE atr > 0 AND ((low > ph AND low - ph >= 0.25::DOUBLE * atr) OR (high < pl AND pl - high >= 0.25::DOUBLE * atr)))""",
)


@query(
    with_bars(
        """SELECT g.symbol, g.ts, up, round(lo, 6) AS gap_low, round(hi, 6) AS gap_high, round(vr, 6) AS volume_ratio, (SELECT min(b.n) - 1 FROM b WHERE b.symbol = g.symbol AND b.n > g.n AND CASE WHEN up THEN b.low <= lo ELSE b.high >= hi END) AS filled_at,
  (SELECT min(b.n) - 1 FROM b WHERE b.symbol = g.symbol AND b.n > g.n AND CASE WHEN up THEN b.close < lo ELSE b.close > hi END) AS closed_through_at FROM g""",
        *_GAPS,
        recursive=True,
    )
)
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    g = T.gaps(I.atr(bars(spark, sf)))
    return rounded(g.select("symbol", "ts", "up", "gap_low", "gap_high", "volume_ratio", F.col("filled_at").cast("long").alias("filled_at"), F.col("closed_through_at").cast("long").alias("closed_through_at")))


@query(
    with_bars(
        """SELECT symbol, ts, n_open, round(sup[2], 6) AS support_low, round(sup[1], 6) AS support_high, round(res[1], 6) AS resistance_low, round(res[2], 6) AS resistance_high
FROM (SELECT b.symbol, b.ts, count(f.n) AS n_open, max(CASE WHEN up AND hi <= b.close THEN [hi, lo] END) AS sup, min(CASE WHEN NOT up AND lo >= b.close THEN [lo, hi] END) AS res
  FROM b LEFT JOIN f ON f.symbol = b.symbol AND f.n <= b.n AND (f.filled IS NULL OR f.filled > b.n) GROUP BY b.symbol, b.ts)""",
        *_GAPS,
        "f AS MATERIALIZED (SELECT g.symbol, g.n, up, lo, hi, (SELECT min(b.n) FROM b WHERE b.symbol = g.symbol AND b.n > g.n AND CASE WHEN up THEN b.low <= lo ELSE b.high >= hi END) AS filled FROM g)",
        recursive=True,
    )
)
def open_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """On each bar the nearest open gap below and above its close."""
    return rounded(T.open_gaps(I.atr(bars(spark, sf))))


@query(
    with_bars(
        f"""SELECT symbol, ts, kind, outside, round(least(1, 0.25::DOUBLE + least(0.3::DOUBLE, 0.15::DOUBLE * rr) + least(0.3::DOUBLE, 0.15::DOUBLE * vr) + CASE WHEN outside THEN 0.15::DOUBLE ELSE 0 END), 6) AS significance, kind = 'bottom' AND vr >= 1.8 AS is_climax FROM (
SELECT *, CASE WHEN high >= eh - 1e-12 AND close < pc THEN 'top' WHEN low <= el + 1e-12 AND close > pc THEN 'bottom' END AS kind, high > ph AND low < pl AS outside, CASE WHEN ar > 0 THEN (high - low) / ar ELSE 1 END AS rr, CASE WHEN av > 0 THEN volume / av ELSE 1 END AS vr FROM (
SELECT *, max(high) OVER {w(20)} AS eh, min(low) OVER {w(20)} AS el, lag(close) OVER ({ORDER}) AS pc, lag(high) OVER ({ORDER}) AS ph, lag(low) OVER ({ORDER}) AS pl, avg(high - low) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ar, avg(volume) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av FROM b))
WHERE kind IS NOT NULL"""
    )
)
def reversal_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.reversal_bars(bars(spark, sf)))


@query(
    with_bars(
        """SELECT symbol, known AS confirmed_index, kind, bias FROM (SELECT *, CASE WHEN kind = 'peak' AND price > pp AND osc < po THEN 'bearish' WHEN kind = 'trough' AND price < pp AND osc > po THEN 'bullish' END AS bias
FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY known) AS pp, lag(osc) OVER (PARTITION BY symbol, kind ORDER BY known) AS po FROM ko)) WHERE bias IS NOT NULL""",
        *SWINGS,
        f"mo AS (SELECT symbol, n, round(avg(close) OVER {w(5)} - avg(close) OVER {w(20)}, 8) AS osc FROM b)",
        "ko AS (SELECT pv.*, mo.osc FROM pv JOIN mo ON mo.symbol = pv.symbol AND mo.n = pv.known + 1)",
        recursive=True,
    )
)
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Price and an oscillator (the means of 5 and 20 closes) parting px_at successive pivots of a kind."""
    b = bars(spark, sf).withColumn("osc", F.round(I.sma("close", 5) - I.sma("close", 20), 8))
    d = T.divergence(K.swings(I.atr(b)), b, "osc")
    return d.select("symbol", F.col("confirmed_index").cast("long").alias("confirmed_index"), "kind", "bias")


@query(
    with_bars(
        """SELECT symbol, ts, max(high) OVER s AS high_since, min(low) OVER s AS low_since FROM (SELECT b.symbol, b.ts, b.high, b.low, sum(CASE WHEN pv.known IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS k
FROM b LEFT JOIN pv ON pv.symbol = b.symbol AND pv.known = b.n - 1) WINDOW s AS (PARTITION BY symbol, k ORDER BY ts)""",
        *SWINGS,
        recursive=True,
    )
)
def extremes_since_pivot(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    return T.extremes_since_pivot(b, K.swings(I.atr(b))).select("symbol", "ts", "high_since", "low_since")


@query(
    with_bars(
        """SELECT symbol, known AS confirmed_index, round(t1, 6) AS third, round(t2, 6) AS two_thirds, CASE WHEN e > o THEN CASE WHEN price >= t2 THEN 'above_2/3' WHEN price >= t1 THEN 'between' ELSE 'below_1/3' END ELSE CASE WHEN price <= t2 THEN 'below_2/3' WHEN price <= t1 THEN 'between' ELSE 'above_1/3' END END AS zone
FROM (SELECT *, CASE WHEN e_at <= o_at THEN o ELSE o + (e - o) / 3 / (e_at - o_at) * (px_at - o_at) END AS t1, CASE WHEN e_at <= o_at THEN o ELSE o + (e - o) * (2.0::DOUBLE / 3) / (e_at - o_at) * (px_at - o_at) END AS t2
FROM (SELECT *, lag(price, 2) OVER q AS o, lag(px_at, 2) OVER q AS o_at, lag(price) OVER q AS e, lag(px_at) OVER q AS e_at FROM pv WINDOW q AS (PARTITION BY symbol ORDER BY known)) WHERE o IS NOT NULL)""",
        *SWINGS,
        recursive=True,
    )
)
def speedlines(spark: SparkSession, sf: str) -> DataFrame:
    z = T.speed_zone(pivots(spark, sf))
    return rounded(z.withColumn("confirmed_index", F.col("confirmed_index").cast("long")))


@query(
    with_bars(
        "SELECT symbol, ts, CASE WHEN up THEN 'bottom' ELSE 'top' END AS island, n - pn AS bars_apart FROM (SELECT *, lag(up) OVER q AS pu, lag(n) OVER q AS pn FROM g WINDOW q AS (PARTITION BY symbol ORDER BY n)) WHERE pu <> up AND n - pn <= 20",
        *_GAPS,
        recursive=True,
    )
)
def island_reversals(spark: SparkSession, sf: str) -> DataFrame:
    b = I.atr(bars(spark, sf))
    return T.islands(T.gaps(b), b).withColumn("bars_apart", F.col("bars_apart").cast("long"))


@query(
    with_bars(
        """SELECT symbol, ts, mb AS move_bars, type, round(CASE WHEN type = 'runaway' THEN lo + hi - pp END, 6) AS objective FROM (SELECT *, CASE WHEN (vr >= 1.5 AND mb <= 3) OR mb <= 2 THEN 'breakaway' WHEN mb > 3 AND mb <= 40 AND vr >= 2.4::DOUBLE THEN 'exhaustion' WHEN mb > 3 AND mb <= 40 THEN 'runaway' WHEN mb > 40 THEN 'exhaustion' ELSE 'common' END AS type
FROM (SELECT g.*, coalesce(g.n - 1 - (SELECT arg_max(px_at, known) FROM pv WHERE pv.symbol = g.symbol AND pv.known <= g.n - 1), 0) AS mb, (SELECT arg_max(price, known) FROM pv WHERE pv.symbol = g.symbol AND pv.known <= g.n - 1) AS pp FROM g))""",
        *SWINGS,
        *_GAPS[2:],
        recursive=True,
    )
)
def gap_types(spark: SparkSession, sf: str) -> DataFrame:
    b = I.atr(bars(spark, sf))
    t = T.typed_gaps(T.gaps(b), b, K.swings(b))
    return rounded(t.withColumn("move_bars", F.col("move_bars").cast("long")))
