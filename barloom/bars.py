"""Bars: symbol, ts, open, high, low, close, volume, vwap; and what the driver's tables give of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_symbol(*order: str) -> Window:
    return Window.partitionBy("symbol").orderBy(*(order or ("ts",)))


def trailing(n: int, *order: str) -> Window:
    """The current row and the n - 1 before it."""
    return by_symbol(*order).rowsBetween(1 - n, 0)


def so_far(*order: str) -> Window:
    return by_symbol(*order).rowsBetween(Window.unboundedPreceding, 0)


def numbered(bars: DataFrame, name: str = "i") -> DataFrame:
    """bars with the place of each in its symbol, from 0."""
    return bars.withColumn(name, F.row_number().over(by_symbol()) - 1)


def ticks_to_bars(ticks: DataFrame, every: str, symbol: Column, price: Column, order: Column, volume: Column, ts: str = "ts") -> DataFrame:
    """Bars of ``every`` (an interval such as '1 hour') from single prices; order decides which price is first and last."""
    t = ticks.select(symbol.alias("symbol"), F.window(ts, every).getField("start").alias("bucket"), price.alias("price"), order.alias("o"), volume.alias("v"))
    return t.groupBy("symbol", F.col("bucket").alias("ts")).agg(
        F.min_by("price", "o").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "o").alias("close"),
        F.sum("v").cast("double").alias("volume"),
        F.avg("price").alias("vwap"),
    )


def event_bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    """Bars of the events table: its type is the symbol, its value the price, and each event a unit of volume."""
    e = read(spark, sf_dir, "events")
    return ticks_to_bars(e, every, F.col("event_type"), F.col("value"), F.struct("ts", "event_id"), F.lit(1))


def ship_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the unit prices shipped, by return flag."""
    li = read(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return ticks_to_bars(li, "1 day", F.col("l_returnflag"), unit, F.struct("l_orderkey", "l_linenumber"), F.col("l_quantity"), "l_shipdate")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, by priority."""
    o = read(spark, sf_dir, "orders")
    return ticks_to_bars(o, "1 day", F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1), "o_orderdate")


def roll_up(bars: DataFrame, bucket: Column, closed_only: bool = True) -> DataFrame:
    """Bars of larger buckets. closed_only: a symbol's last bucket, which may still change, is left out."""
    out = bars.withColumn("bucket", bucket).groupBy("symbol", "bucket").agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.max("ts").alias("last_ts"),
    )
    if closed_only:
        out = out.withColumn("_last", F.max("bucket").over(Window.partitionBy("symbol"))).where(F.col("bucket") < F.col("_last")).drop("_last")
    return out.withColumnRenamed("bucket", "ts")


def latest_wins(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], strict: bool = False) -> DataFrame:
    """left with the latest row of right at or before (strict: before) each ts.

    Both sides are stacked and sorted once, and right's values are carried forward: one shuffle, no inequality join.
    """
    side = F.lit(1 if strict else 0)
    lcols = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.lit(0 if strict else 1).alias("_side"), F.struct(*lcols).alias("_left"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, ts, side.alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*columns).alias("_right"))
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    return both.select(*keys, ts, *[F.col(f"_left.{c}").alias(c) for c in lcols], *[F.col(f"_right.{c}").alias(c) for c in columns])
