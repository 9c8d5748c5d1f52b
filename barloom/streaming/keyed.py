"""Stateful streams over a symbol's bars: typed state in RocksDB, begun from a batch plan if wanted, late rows as an output.

Each symbol keeps a high-water mark: the newest ts it has had. A bar at or before it is late for that symbol alone; it
changes nothing and comes out marked, so that what was dropped can be counted. Bars of a batch are taken in order of ts.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.session import ship_package


#: Workers have no session to parse DDL with: state schemas are made where a processor is.
RING = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("x", T.DoubleType())])


class Stepper(StatefulProcessor):
    """A step function whose state is a row: columns, start and step as in live.stateful, state and out as DDL."""

    def __init__(self, start: Callable[[], dict], step: Callable[[dict, tuple], tuple[dict, dict | None]], columns: list[str], state: str, out: str):
        self.start, self.step, self.columns = start, step, columns
        fields = T.StructType.fromDDL(state)
        self.kind = T.StructType([T.StructField("_last", T.TimestampNTZType()), *fields])
        self.names, self.made = fields.names, T.StructType.fromDDL(out).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.kind)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.held.update((initialState["_last"], *[initialState[n] for n in self.names]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.held.get() if self.held.exists() else None
        last, s = (known[0], dict(zip(self.names, known[1:]))) if known else (None, self.start())
        out = []
        for r in sorted(rows, key=lambda r: r["ts"]):
            if last is not None and r["ts"] <= last:
                out.append(Row(symbol=key[0], ts=r["ts"], late=True, **dict.fromkeys(self.made)))
                continue
            last = r["ts"]
            s, made = self.step(s, tuple(r[c] for c in self.columns))
            if made is not None:
                out.append(Row(symbol=key[0], ts=last, late=False, **{n: made[n] for n in self.made}))
        self.held.update((last, *[s[n] for n in self.names]))
        yield from out


class Extreme:
    """The largest of the last n values (smallest with sign -1): values that a later one has passed can't be it any more."""

    def __init__(self, n: int, sign: int = 1):
        self.n, self.sign, self.at, self.kept = n, sign, 0, deque()

    def push(self, x: float) -> float:
        while self.kept and self.sign * self.kept[-1][1] <= self.sign * x:
            self.kept.pop()
        self.kept.append((self.at, x))
        if self.kept[0][0] <= self.at - self.n:
            self.kept.popleft()
        self.at += 1
        return self.kept[0][1]


class Roller(StatefulProcessor):
    """Mean, deviation, largest and smallest of a symbol's last n values, by count of rows.

    The ring of values is list state, written again once for each batch and symbol; deques of the extremes follow from it.
    A symbol that has had nothing for ``idle_ms`` of processing time is forgotten and begins anew.
    """

    def __init__(self, n: int, column: str, idle_ms: int | None):
        self.n, self.column, self.idle_ms = n, column, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", RING, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ring = deque(self.ring.get() if self.ring.exists() else (), maxlen=self.n)
        last = ring[-1][0] if ring else None
        top, bottom = Extreme(self.n), Extreme(self.n, -1)
        for _, x in ring:
            top.push(x)
            bottom.push(x)
        out = []
        for r in sorted(rows, key=lambda r: r["ts"]):
            if last is not None and r["ts"] <= last:
                out.append(Row(symbol=key[0], ts=r["ts"], late=True, n=None, mean=None, std=None, high=None, low=None))
                continue
            last, x = r["ts"], r[self.column]
            ring.append((last, x))
            mean = math.fsum(v for _, v in ring) / len(ring)
            std = math.sqrt(math.fsum((v - mean) ** 2 for _, v in ring) / (len(ring) - 1)) if len(ring) > 1 else 0.0
            out.append(Row(symbol=key[0], ts=last, late=False, n=len(ring), mean=mean, std=std, high=top.push(x), low=bottom.push(x)))
        self.ring.put(list(ring))
        yield from out


def _transformed(bars: DataFrame, processor: StatefulProcessor, out: str, time_mode: str = "None", begun: DataFrame | None = None) -> DataFrame:
    ship_package(bars.sparkSession)
    initial = begun.groupBy("symbol") if begun is not None else None
    schema = T.StructType.fromDDL(f"symbol string, ts timestamp_ntz, late boolean, {out}")
    return bars.groupBy("symbol").transformWithState(processor, schema, "append", time_mode, initial)


def stepped(bars: DataFrame, start: Callable[[], dict], step: Callable[[dict, tuple], tuple[dict, dict | None]], columns: list[str], state: str, out: str, begun: DataFrame | None = None) -> DataFrame:
    """(symbol, ts, late, *out) of a stream of bars. begun: (symbol, _last, *state), the state a batch plan leaves at its last bar.

    Symbols that begun doesn't have start with ``start``; ts is timestamp_ntz. Late bars have nulls in out.
    """
    return _transformed(bars, Stepper(start, step, columns, state, out), out, begun=begun)


def rolling(bars: DataFrame, n: int, column: str = "close", idle_ms: int | None = None) -> DataFrame:
    """(symbol, ts, late, n, mean, std, high, low) of each bar's last n values of a stream; late bars have nulls."""
    return _transformed(bars, Roller(n, column, idle_ms), "n long, mean double, std double, high double, low double", "ProcessingTime" if idle_ms else "None")


def side_joined(bars: DataFrame, side: DataFrame, values: list[str], reach: str, late: str = "0 seconds") -> DataFrame:
    """A stream of bars with the values of a slow side stream whose ts is in (bar's ts - reach, bar's ts]; nulls without one.

    Both streams have symbol and ts, with watermarks of their own. The state of a bar goes once the side's watermark has
    passed it, that of a side row once bars have passed its reach; a bar without a side comes out then. Several side rows in
    reach give several rows. Side rows that come after the watermark are dropped, and their bars stay without.
    """
    b = bars.withWatermark("ts", late).alias("b")
    s = side.select("symbol", F.col("ts").alias("side_ts"), *values).withWatermark("side_ts", late).alias("s")
    near = (F.col("b.symbol") == F.col("s.symbol")) & (F.col("side_ts") <= F.col("ts")) & (F.col("side_ts") > F.col("ts") - F.expr(f"INTERVAL {reach}"))
    return b.join(s, near, "left_outer").select("b.*", "side_ts", *values)


def forming(ticks: DataFrame, bucket: Column, symbol: str = "symbol") -> DataFrame:
    """Bars of all buckets of a stream, those still forming included, for output mode update: a bar comes again when it changes.

    ticks: symbol, ts, open, high, low, close, volume. State grows with the buckets until a watermark of the stream closes them.
    """
    g = ticks.withColumn("bucket", bucket).groupBy(symbol, "bucket").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return g.withColumnRenamed("bucket", "ts")


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a batch's rows under its number: a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upserted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that upsert_into kept the newest of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def with_forming(bars: DataFrame) -> DataFrame:
    """bars with ``forming``: true for a symbol's newest bar, which features don't read."""
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("_newest"))
    return bars.join(newest, "symbol").withColumn("forming", F.col("ts") == F.col("_newest")).drop("_newest")
