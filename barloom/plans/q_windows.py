"""Rolling-window indicators over hourly event bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.plans.registry import query
from barloom.plans.sql import ORDER, with_bars, w


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_row(B.event_bars(spark, sf))


def show(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """symbol, ts and the columns, numbers rounded."""
    kinds = dict(df.dtypes)
    return df.select("symbol", "ts", *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


@query(with_bars(f"SELECT symbol, ts, round(avg(close) OVER {w(20)}, 8) AS sma20, round(avg(close) OVER {w(50)}, 8) AS sma50 FROM b"))
def sma(spark: SparkSession, sf: str) -> DataFrame:
    return show(bars(spark, sf).withColumns({"sma20": I.sma("close", 20), "sma50": I.sma("close", 50)}), "sma20", "sma50", digits=8)


@query(with_bars(f"""SELECT symbol, ts, round(list_sum(list_transform(l, lambda x, i: x * i)) / (len(l) * (len(l) + 1) / 2.0::DOUBLE), 6) AS wma20 FROM (SELECT symbol, ts, list(close) OVER {w(20)} AS l FROM b)"""))
def wma(spark: SparkSession, sf: str) -> DataFrame:
    return show(bars(spark, sf).withColumn("wma20", I.wma("close", 20)), "wma20")


@query(
    with_bars(f"""SELECT symbol, ts, round(close - first_value(close) OVER {w(11)}, 6) AS momentum10,
  round(CASE WHEN abs(first_value(close) OVER {w(13)}) < 1e-12 THEN 0 ELSE (close - first_value(close) OVER {w(13)}) / first_value(close) OVER {w(13)} END, 6) AS roc12 FROM b""")
)
def momentum_roc(spark: SparkSession, sf: str) -> DataFrame:
    return show(bars(spark, sf).withColumns({"momentum10": I.momentum("close", 10), "roc12": I.roc("close", 12)}), "momentum10", "roc12")


@query(
    with_bars(f"""SELECT symbol, ts, round(avg(close) OVER {w(50)}, 8) AS mean, round(coalesce(stddev_samp(close) OVER {w(50)}, 0), 8) AS std, max(close) OVER {w(50)} AS high, min(close) OVER {w(50)} AS low,
  round(CASE WHEN coalesce(stddev_samp(close) OVER {w(50)}, 0) <= 1e-12 THEN 0 ELSE (close - avg(close) OVER {w(50)}) / stddev_samp(close) OVER {w(50)} END, 8) AS zscore FROM b""")
)
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = B.trailing(50)
    df = bars(spark, sf).select(
        "symbol", "ts", F.avg("close").over(t).alias("mean"), F.coalesce(F.stddev_samp("close").over(t), F.lit(0.0)).alias("std"),
        F.max("close").over(t).alias("_h"), F.min("close").over(t).alias("_l"), I.zscore("close", 50).alias("zscore"),
    )
    return show(df.withColumnsRenamed({"_h": "high", "_l": "low"}), "mean", "std", "high", "low", "zscore", digits=8)


@query(with_bars(f"SELECT symbol, ts, round(len(list_filter(l, lambda x: x <= close)) / len(l)::DOUBLE, 6) AS pct_rank FROM (SELECT symbol, ts, close, list(close) OVER {w(60)} AS l FROM b)"))
def pct_rank(spark: SparkSession, sf: str) -> DataFrame:
    return show(bars(spark, sf).withColumn("pct_rank", I.percentile_rank("close", 60)), "pct_rank")


@query(
    with_bars(f"""SELECT symbol, ts, h AS don_high, l AS don_low, round(CASE WHEN h - l <= 1e-12 THEN 0.5 ELSE (close - l) / (h - l) END, 6) AS channel_pos
FROM (SELECT *, max(high) OVER {w(40)} AS h, min(low) OVER {w(40)} AS l FROM (SELECT symbol, ts, high, low, close FROM b))""")
)
def donchian(spark: SparkSession, sf: str) -> DataFrame:
    t = B.trailing(40)
    df = bars(spark, sf).withColumns({"don_high": F.max("high").over(t), "don_low": F.min("low").over(t)})
    span = F.col("don_high") - F.col("don_low")
    return show(df.withColumn("channel_pos", F.when(span <= 1e-12, 0.5).otherwise((F.col("close") - F.col("don_low")) / span)), "don_high", "don_low", "channel_pos")


@query(
    with_bars(
        f"SELECT symbol, ts, round(raw_k, 6) AS raw_k, round(slow_k, 6) AS slow_k, round(avg(slow_k) OVER {w(3)}, 6) AS slow_d FROM s2",
        f"s1 AS (SELECT symbol, ts, CASE WHEN max(high) OVER {w(14)} - min(low) OVER {w(14)} <= 1e-12 THEN 50 ELSE 100 * (close - min(low) OVER {w(14)}) / (max(high) OVER {w(14)} - min(low) OVER {w(14)}) END AS raw_k FROM b)",
        f"s2 AS (SELECT *, avg(raw_k) OVER {w(3)} AS slow_k FROM s1)",
    )
)
def stochastic(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.stochastic(bars(spark, sf)), "raw_k", "slow_k", "slow_d")


@query(
    with_bars(
        f"SELECT symbol, ts, round(CASE WHEN max(high) OVER {w(14)} - min(low) OVER {w(14)} <= 1e-12 THEN -50 ELSE -100 * (max(high) OVER {w(14)} - close) / (max(high) OVER {w(14)} - min(low) OVER {w(14)}) END, 6) AS williams_r FROM b"
    )
)
def williams_r(spark: SparkSession, sf: str) -> DataFrame:
    return show(bars(spark, sf).withColumn("williams_r", I.williams_r()), "williams_r")


@query(
    with_bars(
        """SELECT symbol, ts, round(CASE WHEN mad <= 1e-12 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * mad) END, 6) AS cci
FROM (SELECT *, list_sum(list_transform(l, lambda x: abs(x - m))) / len(l) AS mad FROM t)""",
        f"t AS (SELECT symbol, ts, tp, avg(tp) OVER {w(20)} AS m, list(tp) OVER {w(20)} AS l FROM (SELECT *, (high + low + close) / 3 AS tp FROM b))",
    )
)
def cci(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.cci(bars(spark, sf)), "cci")


_BB = f"""bb AS (SELECT symbol, ts, n, close, avg(close) OVER {w(20)} AS m, stddev_pop(close) OVER {w(20)} AS s FROM b)"""


@query(
    with_bars(
        """SELECT symbol, ts, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_upper, round(m - 2 * s, 6) AS bb_lower,
  round(CASE WHEN abs(m) <= 1e-12 THEN 0 ELSE 4 * s / m END, 6) AS bb_width, round(CASE WHEN 4 * s <= 1e-12 THEN 0.5 ELSE (close - m + 2 * s) / (4 * s) END, 6) AS percent_b FROM bb WHERE n >= 20""",
        _BB,
    )
)
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    df = I.bollinger(bars(spark, sf)).where(F.col("n") >= 20)
    return show(df, "bb_mid", "bb_upper", "bb_lower", "bb_width", "percent_b")


@query(
    with_bars(
        """SELECT symbol, ts, round(r, 6) AS bb_width_rank, r < 0.10 AND n > 100 AS squeeze FROM (SELECT *, len(list_filter(l, lambda x: x <= v)) / len(l)::DOUBLE AS r FROM l)
WHERE n >= 20""",
        _BB,
        "v AS (SELECT symbol, ts, n, CASE WHEN n >= 2 THEN round(CASE WHEN abs(m) <= 1e-12 THEN 0 ELSE ((m + 2 * s) - (m - 2 * s)) / m END, 9) END AS v FROM bb)",
        f"l AS (SELECT *, list_filter(list(v) OVER {w(100)}, lambda x: x IS NOT NULL) AS l FROM v)",
    )
)
def squeeze(spark: SparkSession, sf: str) -> DataFrame:
    """Bollinger bands that are as narrow as in the lowest tenth of the last 100 bars."""
    df = I.bollinger(bars(spark, sf)).withColumn("v", F.when(F.col("n") >= 2, F.round("bb_width", 9)))
    df = df.withColumn("bb_width_rank", I.percentile_rank("v", 100)).withColumn("squeeze", (F.col("bb_width_rank") < 0.10) & (F.col("n") > 100))
    return show(df.where(F.col("n") >= 20), "bb_width_rank", "squeeze")


@query(with_bars(f"SELECT symbol, ts, round(avg(close) OVER {w(20)}, 6) AS env_mid, round(avg(close) OVER {w(20)} * 1.03::DOUBLE, 6) AS env_upper, round(avg(close) OVER {w(20)} * 0.97::DOUBLE, 6) AS env_lower FROM b"))
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.envelope(bars(spark, sf)), "env_mid", "env_upper", "env_lower")


@query(
    with_bars(
        f"""SELECT symbol, ts, obv, round(sum(sv) OVER ({ORDER}), 6) AS signed_volume, CASE WHEN n >= 20 THEN obv > avg(obv) OVER {w(20)} ELSE obv > 0 END AS obv_rising
FROM (SELECT *, sum(step) OVER ({ORDER}) AS obv FROM o)""",
        f"o AS (SELECT symbol, ts, n, coalesce(sign(close - lag(close) OVER ({ORDER})), 0) * volume AS step, CASE WHEN high - low <= 1e-12 THEN 0 ELSE 2 * (close - low) / (high - low) - 1 END * volume AS sv FROM b)",
    )
)
def obv(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.obv(bars(spark, sf)), "obv", "signed_volume", "obv_rising")


@query(with_bars(f"SELECT symbol, ts, round(coalesce((close - lag(close) OVER ({ORDER})) / nullif(lag(close) OVER ({ORDER}), 0), 0), 8) AS ret FROM b"))
def simple_returns(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("close").over(B.by_symbol())
    return show(bars(spark, sf).withColumn("ret", F.coalesce(F.try_divide(F.col("close") - before, before), F.lit(0.0))), "ret", digits=8)


@query(
    with_bars(
        f"SELECT symbol, ts, avg_body, round(CASE WHEN avg_body <= 1e-12 THEN 1 ELSE volume / nullif(avg(volume) OVER {w(60)}, 0) END, 6) AS volume_ratio FROM (SELECT symbol, ts, volume, round(coalesce(avg(abs(close - open)) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 6) AS avg_body FROM b)"
    )
)
def prior_only_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean body of the 20 bars before a bar, itself not counted, and volume against its mean of 60."""
    prior = B.by_symbol().rowsBetween(-20, -1)
    df = bars(spark, sf).withColumn("avg_body", F.round(F.coalesce(F.avg(F.abs(F.col("close") - F.col("open"))).over(prior), F.lit(0.0)), 6))
    ratio = F.when(F.col("avg_body") <= 1e-12, 1.0).otherwise(F.try_divide(F.col("volume"), F.avg("volume").over(B.trailing(60))))
    return show(df.withColumn("volume_ratio", ratio), "avg_body", "volume_ratio")
