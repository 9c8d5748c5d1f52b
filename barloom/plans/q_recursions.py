"""Recursive indicators: closed forms in Spark, recursive statements in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.plans.q_windows import bars, show
from barloom.plans.registry import query
from barloom.plans.sql import ORDER, TRUE_RANGE, smoothing, summing, with_bars, w


def _join(name: str) -> str:
    return f"JOIN {name} ON {name}.symbol = b.symbol AND {name}.n = b.n"


@query(with_bars(f"SELECT b.symbol, b.ts, round(f.v, 6) AS ema12, round(s.v, 6) AS ema26 FROM b {_join('f')} {_join('s')}", smoothing("f", "b", "close", 12, "2.0::DOUBLE / 13"), smoothing("s", "b", "close", 26, "2.0::DOUBLE / 27"), recursive=True))
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.ema(I.ema(bars(spark, sf), "close", 12, "ema12"), "close", 26, "ema26"), "ema12", "ema26")


RSI = (
    f"d AS MATERIALIZED (SELECT symbol, ts, n - 1 AS m, greatest(close - lag(close) OVER ({ORDER}), 0) AS up, greatest(lag(close) OVER ({ORDER}) - close, 0) AS dn FROM b)",
    smoothing("g", "d", "up", 14, "1.0::DOUBLE / 14", "m"),
    smoothing("l", "d", "dn", 14, "1.0::DOUBLE / 14", "m"),
)


@query(
    with_bars(
        """SELECT b.symbol, b.ts, round(CASE WHEN b.n = 1 THEN 50 WHEN l.v <= 1e-12 THEN CASE WHEN g.v > 1e-12 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g.v / l.v) END, 6) AS rsi
FROM b LEFT JOIN g ON g.symbol = b.symbol AND g.n = b.n - 1 LEFT JOIN l ON l.symbol = b.symbol AND l.n = b.n - 1""",
        *RSI,
        recursive=True,
    )
)
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.rsi(bars(spark, sf)), "rsi")


@query(with_bars(f"SELECT b.symbol, b.ts, round(a.v, 6) AS atr FROM b {_join('a')}", TRUE_RANGE, smoothing("a", "tr", "t", 14, "1.0::DOUBLE / 14"), recursive=True))
def atr(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.atr(bars(spark, sf)), "atr")


@query(
    with_bars(
        """SELECT m.symbol, m.ts, round(m.x, 6) AS macd, round(coalesce(g.v, 0), 6) AS macd_signal, round(m.x - coalesce(g.v, 0), 6) AS macd_hist FROM m LEFT JOIN g ON g.symbol = m.symbol AND g.n = m.k""",
        smoothing("f", "b", "close", 12, "2.0::DOUBLE / 13"),
        smoothing("s", "b", "close", 26, "2.0::DOUBLE / 27"),
        f"m AS MATERIALIZED (SELECT b.symbol, b.ts, b.n - 25 AS k, f.v - s.v AS x FROM b {_join('f')} {_join('s')})",
        smoothing("g", "m", "x", 9, "2.0::DOUBLE / 10", "k"),
        recursive=True,
    )
)
def macd(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.macd(bars(spark, sf)), "macd", "macd_signal", "macd_hist")


_KC = (TRUE_RANGE, smoothing("e", "b", "close", 20, "2.0::DOUBLE / 21"), smoothing("a", "tr", "t", 10, "1.0::DOUBLE / 10"))


@query(
    with_bars(
        """SELECT symbol, ts, round(mid, 6) AS kc_mid, round(u, 6) AS kc_upper, round(l, 6) AS kc_lower,
  coalesce(last_value(CASE WHEN n < 20 THEN NULL WHEN close > u THEN 1 WHEN close < l THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS kc_signal FROM k""",
        *_KC,
        f"k AS (SELECT b.symbol, b.ts, b.n, b.close, e.v AS mid, e.v + 2 * a.v AS u, e.v - 2 * a.v AS l FROM b {_join('e')} {_join('a')})",
        recursive=True,
    )
)
def keltner(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.keltner(bars(spark, sf)), "kc_mid", "kc_upper", "kc_lower", "kc_signal")


@query(
    with_bars(
        "SELECT symbol, ts, round(m, 6) AS starc_mid, round(m + 2 * v, 6) AS starc_upper, round(m - 2 * v, 6) AS starc_lower FROM k",
        TRUE_RANGE,
        smoothing("a", "tr", "t", 15, "1.0::DOUBLE / 15"),
        f"k AS (SELECT b.symbol, b.ts, avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m, a.v FROM b {_join('a')})",
        recursive=True,
    )
)
def starc(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.starc(bars(spark, sf)), "starc_mid", "starc_upper", "starc_lower")


DMI = (
    TRUE_RANGE,
    f"mv AS (SELECT symbol, ts, n - 1 AS m, t, high - lag(high) OVER ({ORDER}) AS up, lag(low) OVER ({ORDER}) - low AS dn FROM tr)",
    "dm AS MATERIALIZED (SELECT symbol, ts, m, t, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q FROM mv)",
    summing("sp", "dm", "p", 14, "m"),
    summing("sq", "dm", "q", 14, "m"),
    summing("sa", "dm", "t", 14, "m"),
    """di AS MATERIALIZED (SELECT dm.symbol, dm.ts, dm.m, CASE WHEN dm.m < 1 OR sa.v <= 1e-12 THEN 0 ELSE 100 * sp.v / sa.v END AS pdi, CASE WHEN dm.m < 1 OR sa.v <= 1e-12 THEN 0 ELSE 100 * sq.v / sa.v END AS mdi
  FROM dm LEFT JOIN sp ON sp.symbol = dm.symbol AND sp.n = dm.m LEFT JOIN sq ON sq.symbol = dm.symbol AND sq.n = dm.m LEFT JOIN sa ON sa.symbol = dm.symbol AND sa.n = dm.m)""",
    "dx AS MATERIALIZED (SELECT *, CASE WHEN pdi + mdi <= 1e-12 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS x FROM di)",
    """ad(symbol, m, v) AS (
  SELECT symbol, m, CAST(0 AS DOUBLE) FROM dx WHERE m = 0
  UNION ALL
  SELECT s.symbol, s.m, CASE WHEN s.m <= 28 THEN e.v + (s.x - e.v) / greatest(1, s.m - 13) ELSE e.v + (s.x - e.v) / 14.0::DOUBLE END FROM ad e JOIN dx s ON s.symbol = e.symbol AND s.m = e.m + 1
)""",
)


@query(with_bars("SELECT dx.symbol, ts, round(pdi, 6) AS plus_di, round(mdi, 6) AS minus_di, round(x, 6) AS dx, round(ad.v, 6) AS adx FROM dx JOIN ad ON ad.symbol = dx.symbol AND ad.m = dx.m", *DMI, recursive=True))
def dmi(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.dmi(bars(spark, sf)), "plus_di", "minus_di", "dx", "adx")


@query(
    with_bars(
        f"""SELECT b.symbol, b.ts, round(CASE WHEN abs(b.close) <= 1e-12 THEN 0 ELSE (f.v - s.v) / b.close END, 6) AS ema_spread,
  round(CASE WHEN abs(b.close) <= 1e-12 THEN 0 ELSE (s.v - coalesce(p.v, s.v)) / b.close END, 6) AS ema_slope, round(CASE WHEN abs(b.close) <= 1e-12 THEN 0 ELSE a.v / b.close END, 6) AS atr_pct, b.n >= 52 AS ready
FROM b {_join('f')} {_join('s')} {_join('a')} LEFT JOIN s p ON p.symbol = b.symbol AND p.n = b.n - 1""",
        TRUE_RANGE,
        smoothing("f", "b", "close", 12, "2.0::DOUBLE / 13"),
        smoothing("s", "b", "close", 26, "2.0::DOUBLE / 27"),
        smoothing("a", "tr", "t", 14, "1.0::DOUBLE / 14"),
        recursive=True,
    )
)
def feature_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The trend part of the feature row."""
    return show(I.feature_snapshot(bars(spark, sf), 24 * 365), "ema_spread", "ema_slope", "atr_pct", "ready")


@query(
    with_bars(
        f"""SELECT symbol, ts, round(CASE WHEN abs(first_value(close) OVER {w(53)}) < 1e-12 THEN 0 ELSE (close - first_value(close) OVER {w(53)}) / first_value(close) OVER {w(53)} END, 6) AS roc_slow,
  round(CASE WHEN coalesce(stddev_samp(volume) OVER {w(50)}, 0) <= 1e-12 THEN 0 ELSE (volume - avg(volume) OVER {w(50)}) / stddev_samp(volume) OVER {w(50)} END, 6) AS volume_z,
  round(coalesce(stddev_samp(ret) OVER {w(50)}, 0) * sqrt(8760), 6) AS realized_vol FROM r""",
        f"r AS (SELECT *, CASE WHEN abs(lag(close) OVER ({ORDER})) > 1e-12 THEN (close - lag(close) OVER ({ORDER})) / lag(close) OVER ({ORDER}) ELSE 0 END AS ret FROM b)",
    )
)
def feature_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """The volatility and volume part of the feature row."""
    return show(I.feature_snapshot(bars(spark, sf), 24 * 365), "roc_slow", "volume_z", "realized_vol")
