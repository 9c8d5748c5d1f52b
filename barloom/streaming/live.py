"""Streaming roll-ups, steps, and how streams are run: what is kept for each symbol is in keyed.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import materialise, shared_dir


def roll_up_stream(ticks: DataFrame, every: str, late: str = "0 seconds", symbol: str = "symbol", ts: str = "ts", price: str = "price") -> DataFrame:
    """Closed bars of a tick stream: a bar comes out once the watermark has passed its end; later ticks of it are dropped."""
    t = ticks.withWatermark(ts, late)
    g = t.groupBy(F.window(ts, every).alias("w"), symbol).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return g.select(F.col(symbol).alias("symbol"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def first_seen_stream(rows: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Rows whose key didn't come up within the watermark's reach."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def ema_start() -> dict:
    return {"n": 0, "v": 0.0}


def ema_step(s: dict, x: float, period: int) -> tuple[dict, dict]:
    """Running mean up to the period, then the exponential average."""
    n = s["n"] + 1
    v = s["v"] + (x - s["v"]) * (1 / n if n <= period else 2 / (period + 1))
    return {"n": n, "v": v}, {"ema": v}


def roller_start() -> dict:
    return {"bucket": None, "bar": None}


def roller_step(s: dict, bucket: str, open_: float, high: float, low: float, close: float, volume: float) -> tuple[dict, dict | None]:
    """A larger bar comes out when the first bar of a later bucket arrives."""
    fresh = {"bucket": bucket, "open": open_, "high": high, "low": low, "close": close, "volume": volume}
    if s["bucket"] is None or bucket > s["bucket"]:
        return {"bucket": bucket, "bar": fresh}, s["bar"]
    if bucket < s["bucket"]:
        return s, None
    b = s["bar"]
    return {"bucket": bucket, "bar": {**b, "high": max(b["high"], high), "low": min(b["low"], low), "close": close, "volume": b["volume"] + volume}}, None


#: State is kept in RocksDB: it outgrows memory, and typed state needs it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, base: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, idle_batches: bool = True) -> None:
    """Run a stream over all that is there now and end; what it knows is kept below base, so that the next run goes on from there.

    Rows go to base/out, or to ``sink`` by foreachBatch. idle_batches: batches without rows, which a watermark needs to close
    what it has passed; state that ends by processing time asks for them for ever, so such a run must do without.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{base}/out")).start()
    q.awaitTermination()


def new_base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table of the shared folder, and read that."""
    base = new_base(stream.sparkSession)
    run_once(stream, base, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def source(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A stream of the rows of the Parquet files below path, those of later files included."""
    return spark.readStream.schema(schema).parquet(path)


def replayed(tables: dict[str, list[DataFrame]], build: Callable[..., DataFrame], mode: str = "append", sink: Callable[[str], Callable[[DataFrame, int], None]] | None = None, idle_batches: bool = True) -> DataFrame:
    """What a stream brings that gets the first part of each table, then the second, and so on.

    ``build`` makes the stream from one stream for each table, by name. Every part is a run of its own that goes on from the
    checkpoint of the one before: the order of parts doesn't hang on the times of files, and each run is a restart. All
    tables have as many parts. ``sink`` makes a foreachBatch sink for a path; its rows are read from there with their batch.
    """
    some = next(iter(tables.values()))
    spark = some[0].sparkSession
    base = new_base(spark)
    for k in range(len(some)):
        for name, parts in tables.items():
            parts[k].write.mode("append").parquet(f"{base}/in/{name}")
        stream = build(**{name: source(spark, parts[0].schema, f"{base}/in/{name}") for name, parts in tables.items()})
        run_once(stream, base, mode, sink(f"{base}/out") if sink else None, idle_batches)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]) if sink else stream.schema
    return spark.read.schema(schema).parquet(f"{base}/out")


def in_parts(bars: DataFrame, parts: int = 3, late: Column | None = None) -> list[DataFrame]:
    """bars by time in so many parts of equal length; those for which ``late`` holds come one part later, or in the last."""
    day = F.to_date("ts")
    held = materialise(bars, "barloom/bars")
    first, last = held.agg(F.min(day), F.max(day)).first()
    span = (last - first).days + 1 if last else 1
    part = F.floor(F.datediff(day, F.lit(first)) * parts / span).cast("int")
    part = F.least(part + F.when(late, 1).otherwise(0), F.lit(parts - 1)) if late is not None else part
    return [held.where(part == k) for k in range(parts)]
