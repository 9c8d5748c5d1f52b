"""Row-level expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import scalars as S
from barloom.plans.registry import query
from barloom.plans.sql import BARS


@query(f"WITH {BARS} SELECT symbol, ts, round((high + low + close) / 3, 6) AS typical, round(CASE WHEN close <= 0 THEN 0 ELSE (high - low) / close END, 6) AS range_pct FROM b0")
def typical_price(spark: SparkSession, sf: str) -> DataFrame:
    return B.event_bars(spark, sf).select("symbol", "ts", F.round(S.typical_price(), 6).alias("typical"), F.round(S.range_pct(), 6).alias("range_pct"))


@query(
    """SELECT event_id, round(CASE WHEN value IS NULL THEN 0 ELSE tanh((value - 35) / 20.0::DOUBLE) END, 8) AS squashed, round(greatest(least((value - 10) / 80.0::DOUBLE, 1), 0) * 0.75::DOUBLE + 0.25::DOUBLE, 8) AS mapped,
  round(1.0 + greatest(least((value - 10) / 80.0::DOUBLE, 1), 0) * -0.75::DOUBLE, 8) AS falling, 0.5::DOUBLE AS reversed_input, CASE WHEN value IS NULL THEN 0 ELSE least(greatest(value, 5), 60) END AS clamped FROM events"""
)
def squash_and_map(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return B.read(spark, sf, "events").select(
        "event_id", F.round(S.squash(v - 35, 20.0), 8).alias("squashed"), F.round(S.linear_map(v, 10, 90, 0.25, 1.0), 8).alias("mapped"),
        F.round(S.linear_map(v, 10, 90, 1.0, 0.25), 8).alias("falling"), S.linear_map(v, 90, 10, 0.5, 1.0).alias("reversed_input"), S.clamp(v, 5.0, 60.0).alias("clamped"),
    )


_ROUND = """p AS (SELECT p_partkey, p_retailprice AS price, pow(10, floor(log10(p_retailprice))) AS pw FROM part WHERE p_retailprice > 0),
lv AS (SELECT DISTINCT p_partkey, price, round((floor(price / s) + k) * s, 10) AS v FROM (SELECT *, unnest([pw, pw / 2, pw / 4]) AS s FROM p), (SELECT unnest(range(-3, 5)) AS k) WHERE round((floor(price / s) + k) * s, 10) > 0)"""


@query(f"WITH {_ROUND} SELECT p_partkey, list(v ORDER BY v) AS levels FROM lv GROUP BY 1")
def round_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return B.read(spark, sf, "part").where("p_retailprice > 0").select("p_partkey", S.round_numbers(F.col("p_retailprice")).alias("levels"))


@query(
    f"""WITH {_ROUND}, n AS (SELECT p_partkey, price, arg_min(v, round(abs(v - price), 9) * 1e6 + v / 1e9) AS level FROM lv GROUP BY 1, 2)
SELECT p_partkey, level, round(CASE WHEN abs(price - level) <= level * 0.002::DOUBLE THEN level - level * 0.002::DOUBLE ELSE price END, 6) AS long_stop,
  round(CASE WHEN abs(price - level) <= level * 0.002::DOUBLE THEN level + level * 0.002::DOUBLE ELSE price END, 6) AS short_stop FROM n"""
)
def offset_stop(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_retailprice")
    return B.read(spark, sf, "part").where(p > 0).select(
        "p_partkey", S.nearest_round_number(p).alias("level"), F.round(S.offset_stop(p, F.lit(True)), 6).alias("long_stop"), F.round(S.offset_stop(p, F.lit(False)), 6).alias("short_stop")
    )


@query(
    """SELECT event_id, CASE WHEN f > 2 / 3.0::DOUBLE THEN 'broken' WHEN f >= 0.618 THEN 'maximum' WHEN f >= 0.40 THEN 'entry' WHEN f >= 1 / 3.0::DOUBLE THEN 'minimum' ELSE 'shallow' END AS zone,
  CASE WHEN span / 24.0 >= 180 THEN 'major' WHEN span / 24.0 >= 21 THEN 'intermediate' ELSE 'near_term' END AS degree FROM (SELECT event_id, value / 97.0::DOUBLE AS f, event_id % 6000 AS span FROM events)"""
)
def retrace_zone(spark: SparkSession, sf: str) -> DataFrame:
    e = B.read(spark, sf, "events")
    return e.select("event_id", S.retracement_zone(F.col("value") / 97.0).alias("zone"), S.degree(F.col("event_id") % 6000, F.lit(24)).alias("degree"))


@query(
    """WITH s AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN lower(substr(n_name, 1, 3)) || '/usd' WHEN 1 THEN substr(n_name, 1, 3) || '/EUR' WHEN 2 THEN substr(n_name, 1, 3) || '/USDT' ELSE lower(n_name) END AS s FROM nation)
SELECT n_nationkey, CASE WHEN contains(s, '/') THEN upper(split_part(s, '/', 1)) || CASE WHEN upper(split_part(s, '/', 2)) = 'USD' THEN 'USDT' ELSE upper(split_part(s, '/', 2)) END ELSE upper(s) END AS venue,
  CASE WHEN split_part(s, '/', 2) IN ('USD', 'USDT', 'USDC') THEN 'crypto_usd' ELSE s END AS grp FROM s"""
)
def venue_symbol(spark: SparkSession, sf: str) -> DataFrame:
    k, base = F.col("n_nationkey") % 4, F.substring("n_name", 1, 3)
    s = F.when(k == 0, F.concat(F.lower(base), F.lit("/usd"))).when(k == 1, F.concat(base, F.lit("/EUR"))).when(k == 2, F.concat(base, F.lit("/USDT"))).otherwise(F.lower("n_name"))
    n = B.read(spark, sf, "nation").withColumn("s", s)
    return n.select("n_nationkey", S.venue_symbol(F.col("s")).alias("venue"), S.group_of(F.col("s")).alias("grp"))


@query("SELECT o_orderkey, make_date(y, greatest(CAST(round(m) AS INTEGER), 1), 1) AS month FROM (SELECT o_orderkey, CAST(floor(x) AS INTEGER) AS y, round((x - floor(x)) * 100) AS m FROM (SELECT o_orderkey, year(o_orderdate) + month(o_orderdate) / 100.0::DOUBLE AS x FROM orders))")
def year_month(spark: SparkSession, sf: str) -> DataFrame:
    x = F.year("o_orderdate") + F.month("o_orderdate") / 100.0
    return B.read(spark, sf, "orders").select("o_orderkey", S.year_month_date(x).alias("month"))


@query(
    f"""WITH {BARS}, a AS (SELECT *, abs(close - open) AS body, high - low AS rng, greatest(open, close) AS top, least(open, close) AS bottom FROM b)
SELECT symbol, ts, round(body, 6) AS body, round(rng, 6) AS rng, close > open AS white, round(high - top, 6) AS upper_shadow, round(bottom - low, 6) AS lower_shadow, round(CASE WHEN rng <= 0 THEN 0 ELSE body / rng END, 6) AS body_frac,
  coalesce(top >= lag(top) OVER o AND bottom <= lag(bottom) OVER o AND body > lag(body) OVER o, false) AS engulfs, coalesce(top <= lag(top) OVER o AND bottom >= lag(bottom) OVER o, false) AS inside FROM a WINDOW o AS (PARTITION BY symbol ORDER BY ts)"""
)
def candle_anatomy(spark: SparkSession, sf: str) -> DataFrame:
    b = B.event_bars(spark, sf).withColumns({
        "body": F.abs(F.col("close") - F.col("open")), "rng": F.col("high") - F.col("low"), "top": F.greatest("open", "close"), "bottom": F.least("open", "close"),
    })
    w = B.by_symbol()
    before = {c: F.lag(c).over(w) for c in ("body", "top", "bottom")}
    return b.select(
        "symbol", "ts", F.round("body", 6).alias("body"), F.round("rng", 6).alias("rng"), (F.col("close") > F.col("open")).alias("white"),
        F.round(F.col("high") - F.col("top"), 6).alias("upper_shadow"), F.round(F.col("bottom") - F.col("low"), 6).alias("lower_shadow"),
        F.round(F.when(F.col("rng") <= 0, 0.0).otherwise(F.col("body") / F.col("rng")), 6).alias("body_frac"),
        F.coalesce((F.col("top") >= before["top"]) & (F.col("bottom") <= before["bottom"]) & (F.col("body") > before["body"]), F.lit(False)).alias("engulfs"),
        F.coalesce((F.col("top") <= before["top"]) & (F.col("bottom") >= before["bottom"]), F.lit(False)).alias("inside"),
    )


@query("SELECT event_id, json_extract_string(props, '$') IS NOT NULL AS has_props, len(json_keys(props)) AS n_props FROM events WHERE props IS NOT NULL")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed JSON of the event properties."""
    e = B.read(spark, sf, "events").where(F.col("props").isNotNull())
    return e.select("event_id", F.lit(True).alias("has_props"), F.json_array_length(F.lit("[]")).alias("_z"), F.size(F.json_object_keys("props")).cast("long").alias("n_props")).drop("_z")
