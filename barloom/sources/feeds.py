"""Bars from outside: a feed interface, a seeded synthetic feed, and parsers of venue payloads."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import ship_package


class Feed(ABC):
    """Closed bars, past and to come."""

    @abstractmethod
    def history(self, spark: SparkSession, start: str, end: str | None = None, symbols: list[str] | None = None) -> DataFrame: ...

    @abstractmethod
    def stream(self, spark: SparkSession) -> DataFrame: ...


class SyntheticFeed(Feed):
    """Prices that switch between rising, falling and sideways regimes; the same seed and symbols always give the same bars."""

    def __init__(self, symbols: list[str], minutes: int = 5, seed: int = 7, price: float = 100.0):
        self.symbols, self.minutes, self.seed, self.price = symbols, minutes, seed, price

    def path(self, symbol: str, n: int) -> pd.DataFrame:
        rng = np.random.default_rng(self.seed + zlib.crc32(symbol.encode()))
        drift, vol = np.empty(n), np.empty(n)
        at = 0
        while at < n:
            length = int(rng.integers(30, 121))
            side = int(rng.integers(-1, 2))
            drift[at : at + length] = side * rng.uniform(2e-4, 8e-4)
            vol[at : at + length] = 0.004 * rng.uniform(0.6, 1.8)
            at += length
        close = np.maximum(self.price * np.cumprod(1 + drift + vol * rng.standard_normal(n)), 0.01)
        open_ = np.concatenate([[self.price], close[:-1]])
        top, bottom = np.maximum(open_, close), np.minimum(open_, close)
        high = top * (1 + np.abs(rng.standard_normal(n)) * vol / 2)
        low = np.maximum(bottom * (1 - np.abs(rng.standard_normal(n)) * vol / 2), 0.01)
        volume = np.round(rng.gamma(2.0, 500.0, n) * (1 + np.abs(close / open_ - 1) * 50), 2)
        out = pd.DataFrame({"open": open_, "high": high, "low": low, "close": close}).round(4)
        out["volume"], out["vwap"] = volume, out[["open", "high", "low", "close"]].mean(axis=1).round(4)
        return out

    def history(self, spark: SparkSession, start: str, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
        ship_package(spark)
        first = pd.Timestamp(start)
        last = pd.Timestamp(end) if end else first + pd.Timedelta(days=30)
        n = int((last - first) / pd.Timedelta(minutes=self.minutes))
        wanted = [s for s in self.symbols if symbols is None or s in symbols]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            symbol = pdf["symbol"].iloc[0]
            out = self.path(symbol, n)
            out.insert(0, "ts", first + pd.to_timedelta(np.arange(n) * self.minutes, unit="min"))
            out.insert(0, "symbol", symbol)
            return out

        names = spark.createDataFrame([(s,) for s in wanted], "symbol string")
        return names.groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, vwap double")

    def stream(self, spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
        """An endless bar for each symbol and tick, from the rate source: prices follow sums of slow waves."""
        ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
        wave = lambda k, phase: F.sin(k / F.lit(37.0) + phase) * 0.02 + F.sin(k / F.lit(211.0) + phase) * 0.08
        phase = F.pmod(F.crc32(F.col("symbol").cast("binary")), F.lit(628)) / 100
        symbols = ticks.select("timestamp", "value", F.explode(F.array(*[F.lit(s) for s in self.symbols])).alias("symbol"))
        close, open_ = F.lit(self.price) * (1 + wave(F.col("value") + 1, phase)), F.lit(self.price) * (1 + wave(F.col("value"), phase))
        return symbols.select(
            "symbol", F.col("timestamp").alias("ts"), open_.alias("open"), (F.greatest(open_, close) * 1.001).alias("high"), (F.least(open_, close) * 0.999).alias("low"), close.alias("close"), F.lit(1000.0).alias("volume"),
        )


def number(c: Column) -> Column:
    """A double from text; null for what isn't a finite number."""
    x = c.try_cast("double") if hasattr(c, "try_cast") else F.expr("NULL")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


CHART = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"


def parse_chart(payloads: DataFrame, symbol: str = "symbol", json: str = "payload") -> DataFrame:
    """Bars from parallel arrays of one JSON document for each symbol.

    A place without a close is no bar; a missing open, high or low is the close, a missing volume nothing.
    """
    p = payloads.select(F.col(symbol).alias("symbol"), F.from_json(json, CHART).alias("p"))
    rows = p.select("symbol", F.explode(F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")])).alias("r")).select("symbol", "r.*")
    rows = rows.where("close IS NOT NULL AND timestamp IS NOT NULL")
    return rows.select("symbol", F.timestamp_seconds("timestamp").cast("timestamp_ntz").alias("ts"), *[F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")], "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def parse_klines(payloads: DataFrame, now_ms: Column, symbol: str = "symbol", json: str = "payload") -> DataFrame:
    """Bars from arrays [open time, open, high, low, close, volume, close time] with numbers as text.

    A repeated open time counts once (the last of its kind), and a bar that closes after ``now_ms`` is still forming and
    is held back.
    """
    p = payloads.select(F.col(symbol).alias("symbol"), F.posexplode(F.from_json(json, "array<array<string>>")).alias("k", "r"))
    at = lambda i: F.try_element_at("r", F.lit(i + 1))
    rows = p.select("symbol", "k", at(0).cast("bigint").alias("open_ms"), *[at(i).cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)], at(6).cast("bigint").alias("close_ms"))
    rows = rows.where(F.col("close_ms") <= now_ms)
    w = Window.partitionBy("symbol", "open_ms").orderBy(F.desc("k"))
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select("symbol", F.timestamp_millis("open_ms").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def forming_bars(bars: DataFrame) -> DataFrame:
    """Each symbol's newest bar, for display only."""
    return bars.withColumn("_last", F.max("ts").over(Window.partitionBy("symbol"))).where(F.col("ts") == F.col("_last")).drop("_last")


def parse_funding(pages: DataFrame, most: int | None = None, symbol: str = "symbol", json: str = "payload") -> DataFrame:
    """Funding settlements from pages of [{"fundingTime", "fundingRate", "markPrice"}], once for each stamp, oldest first."""
    rows = pages.select(F.col(symbol).alias("symbol"), F.explode(F.from_json(json, "array<struct<fundingTime:bigint,fundingRate:string,markPrice:string>>")).alias("r"))
    rows = rows.select("symbol", F.timestamp_millis("r.fundingTime").cast("timestamp_ntz").alias("ts"), number(F.col("r.fundingRate")).alias("rate"), number(F.col("r.markPrice")).alias("mark_price")).where("rate IS NOT NULL")
    rows = rows.dropDuplicates(["symbol", "ts"])
    if most:
        w = Window.partitionBy("symbol").orderBy("ts")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return rows


def parse_contracts(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """The contract dimension from an exchange document: perpetual contracts that trade."""
    schema = "struct<symbols:array<struct<symbol:string,baseAsset:string,quoteAsset:string,contractType:string,status:string,onboardDate:bigint,maintMarginPercent:string>>>"
    rows = payloads.select(F.explode(F.from_json(json, schema)["symbols"]).alias("c")).select("c.*").where("contractType = 'PERPETUAL' AND status = 'TRADING'")
    maint = F.coalesce(number(F.col("maintMarginPercent")), F.lit(0.0)) / 100
    return rows.select("symbol", F.col("baseAsset").alias("base"), F.col("quoteAsset").alias("quote"), F.col("onboardDate").alias("onboard_ms"), maint.alias("maint_margin"), F.when(maint <= 0, 125.0).otherwise(1 / maint).alias("max_leverage"))


def search_contracts(contracts: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Contracts whose symbol or base holds the needle: exact bases first, then the oldest."""
    n = needle.strip().upper()
    hit = F.contains(F.upper("symbol"), F.lit(n)) | F.contains(F.upper("base"), F.lit(n))
    return contracts.where(hit).orderBy(F.upper("base") != n, "onboard_ms", "symbol").limit(limit)


def parse_valuations(rows: DataFrame, date: str = "date") -> DataFrame:
    """Monthly valuation rows: YYYY.MM dates, numbers as text; real price is price over the price index."""
    from barloom.functions.scalars import year_month_date

    numbers = {c: number(F.col(c).cast("string")) for c in rows.columns if c != date}
    out = rows.select(year_month_date(number(F.col(date).cast("string"))).alias("month"), *[v.alias(c) for c, v in numbers.items()]).where("month IS NOT NULL AND price IS NOT NULL")
    return out.withColumn("real_price", F.try_divide("price", "cpi")) if "cpi" in rows.columns else out
