"""Streams run to their end, and payload parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.operators import kernels as K
from barloom.plans.q_structure import SAR
from barloom.plans.q_windows import show
from barloom.plans.registry import query
from barloom.plans.sql import smoothing, w, with_bars
from barloom.session import materialise
from barloom.sources import feeds
from barloom.streaming import keyed, live


@query(
    """WITH m AS (SELECT max(ts) AS m FROM events) SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events, m GROUP BY 1, 2, m.m HAVING time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR <= m.m"""
)
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Four-hour bars of the event stream; those that end after the newest event never close."""
    schema = B.read(spark, sf, "events").schema
    ticks = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    return live.drain(live.roll_up_stream(ticks, "4 hours")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_EMA12 = with_bars("SELECT b.symbol, b.ts, round(f.v, 6) AS ema FROM b JOIN f ON f.symbol = b.symbol AND f.n = b.n", smoothing("f", "b", "close", 12, "2.0::DOUBLE / 13"), recursive=True)
EMA_STATE, EMA_OUT = "n long, v double", "ema double"


def ema_stream(bars: DataFrame, begun: DataFrame | None = None) -> DataFrame:
    return keyed.stepped(bars, live.ema_start, lambda s, v: live.ema_step(s, v[0], 12), ["close"], EMA_STATE, EMA_OUT, begun)


@query(_EMA12)
def stream_ema(spark: SparkSession, sf: str) -> DataFrame:
    """EMA(12) of a replayed bar stream, state by state."""
    parts = live.in_parts(B.event_bars(spark, sf).select(*B.BAR))
    return show(live.replayed({"bars": parts}, ema_stream), "ema")


@query(_EMA12)
def stream_warm_start(spark: SparkSession, sf: str) -> DataFrame:
    """EMA(12): the older half by a batch plan, whose last values are the state with which a stream goes on over the newer half."""
    older, newer = live.in_parts(B.event_bars(spark, sf).select(*B.BAR), 2)
    warm = materialise(I.ema(I.with_row(older), "close", 12, "ema").select("symbol", "ts", "n", "ema"), "barloom/warm")
    last = F.max_by(F.struct("ts", "n", "ema"), "ts").alias("l")
    begun = warm.groupBy("symbol").agg(last).select("symbol", F.col("l.ts").alias("_last"), F.col("l.n").cast("long").alias("n"), F.col("l.ema").alias("v"))
    lived = live.replayed({"bars": [newer]}, lambda bars: ema_stream(bars, begun))
    return show(warm.select("symbol", "ts", "ema").unionByName(lived.select("symbol", "ts", "ema")), "ema")


@query(with_bars("SELECT symbol, ts, round(sar, 6) AS sar, up AS is_long, flipped FROM sar", SAR, recursive=True))
def stream_sar(spark: SparkSession, sf: str) -> DataFrame:
    """Parabolic SAR of a replayed bar stream: the batch kernel's step with its state kept between batches."""
    parts = live.in_parts(B.event_bars(spark, sf).select(*B.BAR))
    state = "n long, sar double, ep double, af double, long boolean, h1 double, l1 double, h2 double, l2 double"
    made = live.replayed({"bars": parts}, lambda bars: keyed.stepped(bars, K.sar_start, lambda s, v: K.sar_step(s, *v), ["high", "low"], state, "sar double, is_long boolean, flipped boolean"))
    return show(made, "sar", "is_long", "flipped")


@query(
    with_bars(
        f"""SELECT symbol, ts, count(*) OVER {w(20)} AS n, round(avg(close) OVER {w(20)}, 6) AS mean, round(coalesce(stddev_samp(close) OVER {w(20)}, 0), 6) AS std, max(close) OVER {w(20)} AS high, min(close) OVER {w(20)} AS low FROM b"""
    )
)
def stream_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the last twenty bars of each symbol of a replayed stream."""
    parts = live.in_parts(B.event_bars(spark, sf).select(*B.BAR))
    made = live.replayed({"bars": parts}, lambda bars: keyed.rolling(bars, 20, idle_ms=7 * 86_400_000), idle_batches=False)
    return show(made, "n", "mean", "std", "high", "low")


_LATE = "(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) % 11 = 0)"


@query(
    with_bars(
        f"""SELECT symbol, count(*) AS bars, count(CASE WHEN is_late THEN 1 END) AS late, max(CASE WHEN is_late THEN ts END) AS newest_late, round(avg(CASE WHEN NOT is_late THEN close END), 6) AS mean_close
FROM (SELECT *, coalesce(ts <= max(newest) OVER (PARTITION BY symbol ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_late FROM (SELECT *, max(ts) OVER (PARTITION BY symbol, part) AS newest FROM p)) GROUP BY symbol""",
        f"p AS (SELECT *, least(CAST(floor(date_diff('day', (SELECT min(ts)::DATE FROM b), ts::DATE) * 4 / (SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 FROM b)::DOUBLE) AS INTEGER) + CASE WHEN {_LATE} THEN 1 ELSE 0 END, 3) AS part FROM b)",
    )
)
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of which every eleventh hour comes a part later: how many of each symbol its own newest bar had passed by then."""
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    bars = B.event_bars(spark, sf).select(*B.BAR)
    parts = live.in_parts(bars, 4, late=hours % 11 == 0)
    made = live.replayed({"bars": parts}, lambda bars: keyed.stepped(bars, lambda: {"n": 0}, lambda s, v: ({"n": s["n"] + 1}, {"close": v[0]}), ["close"], "n long", "close double"))
    late = F.col("late")
    return made.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(late).alias("late"), F.max(F.when(late, F.col("ts"))).alias("newest_late"), F.round(F.avg(F.when(~late, F.col("close"))), 6).alias("mean_close")
    )


@query(
    with_bars(
        """SELECT b.symbol, b.ts, b.close, f.ts AS side_ts, f.rate FROM b LEFT JOIN f ON f.symbol = b.symbol AND f.ts <= b.ts AND f.ts > b.ts - INTERVAL 8 HOUR""",
        "f AS (SELECT symbol, ts, round(volume / 1000.0::DOUBLE, 6) AS rate FROM b WHERE hour(ts) % 8 = 0 AND day(ts) % 5 <> 0)",
    )
)
def stream_side(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the settlement of the last eight hours, from a slow stream of its own that lacks every fifth day.

    The settlements of the fifth days come when both streams are long past them, and so never. A mark far ahead in both
    streams ends what waits.
    """
    bars = materialise(B.event_bars(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close", "volume"), "barloom/bars")
    side = bars.where(F.hour("ts") % 8 == 0).select("symbol", "ts", F.round(F.col("volume") / 1000, 6).alias("rate"))
    lost = F.dayofmonth("ts") % 5 == 0
    ahead = F.lit("2100-01-01").cast("timestamp")
    end = spark.range(1).select(F.lit("~").alias("symbol"), ahead.alias("ts"))
    closes, rates = bars.drop("volume"), side
    (b0, b1), (s0, s1) = live.in_parts(closes, 2), live.in_parts(rates.where(~lost), 2)
    parts = {
        "bars": [b0, b1.unionByName(end.withColumn("close", F.lit(0.0))), closes.limit(0)],
        "side": [s0, s1.unionByName(end.withColumn("rate", F.lit(0.0))), rates.where(lost)],
    }
    joined = live.replayed(parts, lambda bars, side: keyed.side_joined(bars, side, ["rate"], "8 HOURS"))
    return joined.where("symbol <> '~'").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "side_ts")})


@query(
    with_bars(
        "SELECT symbol, ts, open, high, low, close, volume, ts = max(ts) OVER (PARTITION BY symbol) AS forming FROM g",
        "g AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2)",
    )
)
def stream_forming(spark: SparkSession, sf: str) -> DataFrame:
    """Four-hour bars of a replayed stream, closed ones and the one that each symbol is in; provisional rows were replaced by key."""
    parts = live.in_parts(B.event_bars(spark, sf).select(*B.BAR), 5)
    bucket = F.window("ts", "4 hours").getField("start")
    rows = live.replayed({"bars": parts}, lambda bars: keyed.forming(bars, bucket), "update", keyed.upsert_into)
    return keyed.with_forming(keyed.upserted(rows, ["symbol", "ts"]))


@query("SELECT DISTINCT event_type AS symbol, user_id, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the event stream, each once for each hour: a key's state goes once the watermark is past its hour."""
    schema = B.read(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    e = e.select(F.col("event_type").alias("symbol"), "user_id", hour.alias("ts"))
    return live.drain(live.first_seen_stream(e, ["symbol", "user_id", "ts"], within="1 hour")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _charts(spark: SparkSession, sf: str) -> DataFrame:
    """One chart document for each event type and day, with holes in its arrays."""
    e = B.read(spark, sf, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") * 0)
    hole = lambda n, c: F.when(F.col("event_id") % n != 0, F.col(c))
    r = F.struct("event_id", "t", hole(5, "value").alias("open"), (F.col("value") + 1).alias("high"), hole(3, "value").alias("low"), hole(7, "value").alias("close"), hole(4, "value").alias("volume"))
    g = e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts")).agg(F.array_sort(F.collect_list(r)).alias("r"))
    return g.select("symbol", F.to_json(F.struct(F.col("r.t").alias("timestamp"), *[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")]), {"ignoreNullFields": "false"}).alias("payload"))


@query(
    """SELECT event_type AS symbol, date_trunc('second', ts)::TIMESTAMP AS ts, value AS open, value + 1 AS high, value AS low, value AS close, CASE WHEN event_id % 4 <> 0 THEN value ELSE 0 END AS volume FROM events WHERE event_id % 7 <> 0"""
)
def parse_chart(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.parse_chart(_charts(spark, sf))


@query(
    """WITH k AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, value, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY event_id DESC) AS k FROM events)
SELECT symbol, ts, value AS open, value + 2 AS high, value - 2 AS low, value + 0.5::DOUBLE AS close, 10.0::DOUBLE AS volume FROM k WHERE k = 1 AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 00:00:00'"""
)
def closed_klines(spark: SparkSession, sf: str) -> DataFrame:
    """Klines with repeated open times and forming bars, a document for each event type and day."""
    e = B.read(spark, sf, "events").withColumn("open_ms", F.unix_millis(F.window("ts", "1 hour").getField("start").cast("timestamp")))
    text = lambda c: c.cast("string")
    v = F.col("value")
    r = F.struct("event_id", F.array(text(F.col("open_ms")), text(v), text(v + 2), text(v - 2), text(v + 0.5), F.lit("10"), text(F.col("open_ms") + 3_600_000)).alias("k"))
    p = e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts")).agg(F.to_json(F.array_sort(F.collect_list(r))["k"]).alias("payload"))
    now = F.unix_millis(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return feeds.parse_klines(p, now)


@query("SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 1")
def funding_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Settlements from overlapping pages of a day: every stamp once; counted with how many events each hour had."""
    e = B.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.window("ts", "1 hour").getField("start").alias("h"), "event_id")
    page = e.withColumn("page", F.explode(F.array(F.col("event_id") % 7, F.col("event_id") % 5)))
    r = F.struct(F.unix_millis(F.col("h").cast("timestamp")).alias("fundingTime"), F.lit("0.0001").alias("fundingRate"), F.lit("nan").alias("markPrice"))
    pages = page.groupBy("symbol", "page", F.to_date("h")).agg(F.to_json(F.collect_list(r)).alias("payload"))
    f = feeds.parse_funding(pages).where("mark_price IS NULL AND rate = 0.0001").select("symbol", "ts")
    n = e.groupBy("symbol", F.col("h").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, ["symbol", "ts"])


@query(
    """WITH c AS (SELECT upper(p_brand) || p_partkey AS symbol, upper(p_brand) AS base, p_size * 1000 + p_partkey AS onboard_ms FROM part WHERE p_partkey % 3 <> 0)
SELECT symbol, base, onboard_ms FROM c WHERE contains(symbol, 'BRAND#1') OR contains(base, 'BRAND#1') ORDER BY base <> 'BRAND#1', onboard_ms, symbol LIMIT 20"""
)
def contract_search(spark: SparkSession, sf: str) -> DataFrame:
    p = B.read(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "CURRENT_QUARTER").otherwise("PERPETUAL")
    c = F.struct(F.concat(F.upper("p_brand"), "p_partkey").alias("symbol"), F.upper("p_brand").alias("baseAsset"), F.lit("USDT").alias("quoteAsset"), kind.alias("contractType"), F.lit("TRADING").alias("status"), (F.col("p_size") * 1000 + F.col("p_partkey")).alias("onboardDate"), F.lit("2.5").alias("maintMarginPercent"))
    docs = p.groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.to_json(F.struct(F.collect_list(c).alias("symbols"))).alias("payload"))
    return feeds.search_contracts(feeds.parse_contracts(docs), "brand#1").select("symbol", "base", "onboard_ms")


@query()
def synthetic_history(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.SyntheticFeed(["BTC/USD", "ETH/USD"]).history(spark, "2024-01-01", "2024-01-08")
