"""Bars: roll-ups, resampling, deduplication, merging, as-of alignment, cache reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.operators import cross_section as X
from barloom.operators import thinning as N
from barloom.plans.registry import query
from barloom.plans.sql import BARS, peers, with_bars


@query(f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, round(vwap, 6) AS vwap FROM b0")
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return B.event_bars(spark, sf).withColumn("vwap", F.round("vwap", 6))


def _rolled(bucket: str) -> str:
    return with_bars(
        f"""SELECT symbol, ts, open, high, low, close, volume, last_ts FROM (
  SELECT symbol, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
    max(ts) AS last_ts, max({bucket}) = max(max({bucket})) OVER (PARTITION BY symbol) AS is_last
  FROM b0 GROUP BY symbol, {bucket}
) WHERE NOT is_last"""
    )


@query(_rolled("time_bucket(INTERVAL 4 HOUR, ts)"))
def bars_4h(spark: SparkSession, sf: str) -> DataFrame:
    """Closed four-hour bars: a symbol's last bucket may still change and is left out."""
    return B.roll_up(B.event_bars(spark, sf), F.window("ts", "4 hours").getField("start"))


@query(_rolled("CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return B.roll_up(B.event_bars(spark, sf), F.date_trunc("DAY", "ts").cast("timestamp_ntz"))


@query(_rolled("CAST(date_trunc('week', ts) AS TIMESTAMP)"))
def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks begin on Monday."""
    return B.roll_up(B.event_bars(spark, sf), F.date_trunc("WEEK", "ts").cast("timestamp_ntz"))


SHIP = """s AS (
  SELECT l_returnflag AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS price,
    l_orderkey * 100 + l_linenumber AS o, l_quantity AS v FROM lineitem
), sb AS (
  SELECT symbol, ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(v) AS volume FROM s GROUP BY 1, 2
)"""


@query(
    f"""WITH {SHIP}, m AS (
  SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close, sum(volume) AS volume FROM sb GROUP BY 1, 2
)
SELECT symbol, ts, round(open + 1e-9, 6) AS open, round(high + 1e-9, 6) AS high, round(low + 1e-9, 6) AS low, round(close + 1e-9, 6) AS close, volume FROM m
WHERE month < (SELECT max(month) FROM m x WHERE x.symbol = m.symbol)"""
)
def resample_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A month's bar has the time of its first day with a bar; the last month of each symbol is left out."""
    daily = B.ship_bars(spark, sf).withColumn("month", F.trunc("ts", "MM"))
    m = daily.groupBy("symbol", "month").agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    m = m.withColumn("last", F.max("month").over(Window.partitionBy("symbol"))).where(F.col("month") < F.col("last"))
    return m.select("symbol", "ts", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("SELECT event_type AS symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, arg_max(value, event_id) AS price, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def bars_dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    """Of the prices with the same symbol and minute the last replaces the others."""
    e = B.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.window("ts", "1 minute").getField("start").alias("ts"), "value", "event_id")
    return e.groupBy("symbol", "ts").agg(F.max_by("value", "event_id").alias("price"), F.max("event_id").alias("event_id"))


@query("SELECT event_type AS symbol, user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def dedupe_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each key wins."""
    e = B.read(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), "user_id").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query(f"WITH {BARS} SELECT symbol, ts, close, row_number() OVER (ORDER BY ts, symbol) AS seq FROM b0")
def merge_order(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols' bars in one order by time, then symbol: places within a day are counted on top of the days before."""
    b = B.event_bars(spark, sf).withColumn("day", F.to_date("ts"))
    days = b.groupBy("day").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "symbol"))
    return b.withColumn("place", place).join(days, "day").select("symbol", "ts", "close", (F.col("place") + F.col("before")).alias("seq"))


@query(f"WITH {BARS} SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM b0 GROUP BY symbol")
def latest_bar(spark: SparkSession, sf: str) -> DataFrame:
    return B.event_bars(spark, sf).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"), F.max_by("volume", "ts").alias("volume"))


@query(
    with_bars(
        """SELECT symbol, ts, CASE WHEN hour(ts) % 2 = 0 THEN round(close * 1.01, 6) ELSE close END AS close, CASE WHEN hour(ts) % 2 = 0 THEN 2 ELSE 1 END AS version FROM b0"""
    )
)
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written again with the same symbol and time replace the ones before."""
    old = B.event_bars(spark, sf).select("symbol", "ts", "close", F.lit(1).alias("version"))
    new = old.where(F.hour("ts") % 2 == 0).select("symbol", "ts", F.round(F.col("close") * 1.01, 6).alias("close"), F.lit(2).alias("version"))
    return old.unionByName(new).groupBy("symbol", "ts").agg(F.max_by("close", "version").alias("close"), F.max("version").alias("version"))


@query(f"WITH {BARS} SELECT symbol, ts, close, CAST(n_back AS INTEGER) AS n_back FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n_back FROM b0) WHERE n_back <= 25")
def cache_recent_n(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return B.event_bars(spark, sf).withColumn("n_back", F.row_number().over(w)).where(F.col("n_back") <= 25).select("symbol", "ts", "close", "n_back")


@query(f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars FROM b0 GROUP BY symbol")
def cache_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return B.event_bars(spark, sf).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("bars"))


@query(
    """SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, count(*) AS n, arg_min(o_totalprice, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_close,
  arg_max(o_totalprice, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS last_close,
  round(arg_max(o_totalprice, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) / arg_min(o_totalprice, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) - 1, 6) AS change
FROM orders GROUP BY 1"""
)
def decade_buckets(spark: SparkSession, sf: str) -> DataFrame:
    o = B.read(spark, sf, "orders").withColumn("k", F.struct(F.to_date("o_orderdate"), "o_orderkey"))
    g = o.groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("o_totalprice", "k").alias("first_close"), F.max_by("o_totalprice", "k").alias("last_close")
    )
    return g.withColumn("change", F.round(F.col("last_close") / F.col("first_close") - 1, 6))


@query(
    with_bars(
        """SELECT symbol, count(*) AS bars, round(date_diff('second', min(ts), max(ts)) / 86400.0::DOUBLE / 365.25::DOUBLE, 8) AS years, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close,
  round(avg(CASE WHEN volume <= 1 THEN 1.0 ELSE 0.0 END), 8) AS thin_share, count(DISTINCT date_trunc('month', ts)) AS months FROM b0 GROUP BY symbol"""
    )
)
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = B.event_bars(spark, sf)
    years = (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 86400.0 / 365.25
    return b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.round(years, 8).alias("years"), F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"),
        F.round(F.avg(F.when(F.col("volume") <= 1, 1.0).otherwise(0.0)), 8).alias("thin_share"), F.countDistinct(F.trunc("ts", "MM")).alias("months"),
    )


@query(
    with_bars(
        """SELECT l.symbol, l.ts, l.close, h.ts AS htf_ts, h.close AS htf_close FROM b0 l ASOF LEFT JOIN h ON l.symbol = h.symbol AND l.ts >= h.known""",
        """d AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_max(close, ts) AS close FROM b0 GROUP BY 1, 2)""",
        """h AS (SELECT d.symbol, d.ts, d.close, min(b0.ts) AS known FROM d JOIN b0 ON b0.symbol = d.symbol AND b0.ts >= d.ts + INTERVAL 4 HOUR GROUP BY ALL)""",
    )
)
def htf_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each bar with the last closed four-hour bar: one is known when the first bar of a later bucket arrives."""
    b = B.event_bars(spark, sf).withColumn("bucket", F.window("ts", "4 hours").getField("start"))
    h = b.groupBy("symbol", "bucket").agg(F.max_by("close", "ts").alias("htf_close"), F.min("ts").alias("first_ts"))
    h = h.withColumn("known", F.lead("first_ts").over(Window.partitionBy("symbol").orderBy("bucket"))).where(F.col("known").isNotNull())
    right = h.select("symbol", F.col("known").alias("ts"), F.col("bucket").alias("htf_ts"), "htf_close")
    return B.as_of(b.select("symbol", "ts", "close"), right, ["symbol"], "ts", ["htf_ts", "htf_close"])


@query(
    with_bars(
        """SELECT symbol, ts, close, coalesce(lead(open) OVER (PARTITION BY symbol ORDER BY ts), -1) AS next_open,
  round(coalesce(lead(open) OVER (PARTITION BY symbol ORDER BY ts) * 1.0002::DOUBLE, -1), 8) AS buy_fill, round(coalesce(lead(open) OVER (PARTITION BY symbol ORDER BY ts) * 0.9998::DOUBLE, -1), 8) AS sell_fill FROM b0"""
    )
)
def next_bar_fills(spark: SparkSession, sf: str) -> DataFrame:
    """A market order fills at its symbol's next open, moved against it by two basis points."""
    nxt = F.lead("open").over(B.by_symbol())
    return B.event_bars(spark, sf).select(
        "symbol", "ts", "close", F.coalesce(nxt, F.lit(-1.0)).alias("next_open"),
        F.round(F.coalesce(nxt * 1.0002, F.lit(-1.0)), 8).alias("buy_fill"), F.round(F.coalesce(nxt * 0.9998, F.lit(-1.0)), 8).alias("sell_fill"),
    )


@query(
    with_bars(
        """SELECT ts, symbol, s AS score_input, n, CASE WHEN n < 3 THEN 0.0 ELSE round((row_number() OVER (PARTITION BY ts ORDER BY s, symbol) - 1) / (n - 1)::DOUBLE * 2 - 1, 8) END AS score
FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM (SELECT symbol, ts, round(close / nullif(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 9) AS s FROM b0) WHERE s IS NOT NULL)"""
    )
)
def cross_section_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each symbol among those with a bar at the same time, from -1 to 1; 0 with under three."""
    s = F.round(F.try_divide(F.col("close"), F.avg("close").over(B.trailing(20))), 9)
    b = B.event_bars(spark, sf).select("symbol", "ts", s.alias("s")).where(F.col("s").isNotNull())
    at = Window.partitionBy("ts")
    n, rank = F.count(F.lit(1)).over(at), F.row_number().over(at.orderBy("s", "symbol"))
    b = b.select("ts", "symbol", "s", n.alias("n"), rank.alias("rank"))
    return b.select("ts", "symbol", F.col("s").alias("score_input"), "n", F.when(F.col("n") < 3, 0.0).otherwise(F.round((F.col("rank") - 1) / (F.col("n") - 1) * 2 - 1, 8)).alias("score"))


_IRREGULAR = """i0 AS MATERIALIZED (SELECT concat(event_type, '-', user_id % 7) AS symbol, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, arg_max(value, struct_pack(t := ts, e := event_id)) AS close FROM events GROUP BY 1, 2),
i1 AS MATERIALIZED (SELECT symbol, ts, round(close / nullif(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 9) AS m FROM i0)"""


@query(f"WITH {_IRREGULAR}, {peers('p', 'i1')} SELECT symbol, ts, m AS value, cnt AS peers, k AS peer_place, sp AS peer_spread, mn AS peer_mean FROM p")
def peers_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each ten-minute bar among the latest bars of all symbols - event types by user group, which have theirs at different times."""
    e = B.read(spark, sf, "events")
    symbol = F.concat(F.col("event_type"), F.lit("-"), F.col("user_id") % 7)
    b = B.ticks_to_bars(e, "10 minutes", symbol, F.col("value"), F.struct("ts", "event_id"), F.lit(1))
    b = b.select("symbol", "ts", F.round(F.try_divide("close", F.avg("close").over(B.trailing(20))), 9).alias("value"))
    return X.peers_as_of(b, "value").where("value IS NOT NULL")


_POINTS = "pt AS (SELECT symbol, ts, close, n - 1 AS place, count(*) OVER (PARTITION BY symbol) AS k FROM b)"


@query(with_bars("SELECT symbol, ts, close, place FROM pt WHERE (k - 1 - place) % CAST(ceil(k / 600.0) AS BIGINT) = 0", _POINTS))
def thinned_points(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's closes at equal strides, at most six hundred, the last among them."""
    return N.strided(B.event_bars(spark, sf).select("symbol", "ts", "close"), "symbol", "ts", F.to_date("ts")).select("symbol", "ts", "close", "place")


@query(
    with_bars(
        "SELECT symbol, g.bucket, max(ts) AS ts, round(avg(close), 6) AS close, count(*) AS n FROM (SELECT pt.*, ((place + 1) * least(k, 240) + k - 1) // k - 1 AS bucket FROM pt) g GROUP BY symbol, g.bucket", _POINTS
    )
)
def thinned_means(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's closes as the means of 240 buckets, the columns of a chart."""
    m = N.bucket_means(B.event_bars(spark, sf), "symbol", "ts", "close", F.to_date("ts"), 240)
    return m.withColumn("close", F.round("close", 6))
