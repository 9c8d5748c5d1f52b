"""A table of bars keyed by (symbol, timeframe, ts): upserts, reads and a read-through."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.bars import latest_wins
from barloom.session import remove

KEYS = ["symbol", "timeframe", "ts"]


class BarStore:
    """Bars in Parquet files below a folder that every executor can reach.

    Each put adds a folder with a version; reads take the newest version of each key, so writers never rewrite what readers
    hold. compact() folds the versions into a new generation, which counts once it is whole; the one before it stays for
    those who still read it until the next compact(). One writer at a time may put or compact.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the whole tables prefix<number> in a folder: names alone are read."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def _generation(self) -> int:
        """The newest generation that is whole: compaction writes the first version of a later one in one job."""
        whole = lambda g: self._has(f"{self.path}/g{g}/version=0/_SUCCESS")
        return next((g for g in reversed(self._numbers(self.path, "g")) if g == 0 or whole(g)), 0)

    def _has(self, file: str) -> bool:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)

    def _all(self) -> DataFrame | None:
        now = f"{self.path}/g{self._generation()}"
        return self.spark.read.parquet(now) if self._numbers(now, "version=") else None

    def put(self, bars: DataFrame, timeframe: str) -> None:
        """Insert bars, or replace those with the same key; times are cut to whole seconds."""
        now = f"{self.path}/g{self._generation()}"
        version = max(self._numbers(now, "version="), default=-1) + 1
        ts = F.date_trunc("SECOND", "ts").cast("timestamp_ntz")
        rows = bars.withColumns({"ts": ts, "timeframe": F.lit(timeframe), "batch": F.lit(uuid.uuid4().hex)})
        rows.write.parquet(f"{now}/version={version}")

    def table(self) -> DataFrame | None:
        rows = self._all()
        return None if rows is None else latest_wins(rows, KEYS, F.desc("version"), F.desc("batch")).drop("version", "batch")

    def get(self, symbol: str, timeframe: str, start: str | None = None, end: str | None = None, newest: int | None = None) -> DataFrame | None:
        """Bars of a symbol in time order; newest: only so many of the last ones."""
        rows = self._all()
        if rows is None:
            return None
        rows = rows.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))  # reaches the scan
        if start:
            rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        rows = latest_wins(rows, KEYS, F.desc("version"), F.desc("batch")).drop("version", "batch")
        if newest is not None:
            rows = rows.orderBy(F.desc("ts")).limit(newest)
        return rows.orderBy("ts")

    def coverage(self) -> DataFrame | None:
        t = self.table()
        return None if t is None else t.groupBy("symbol", "timeframe").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("bars"))

    def count(self, **where: str) -> int:
        t = self.table()
        if t is None:
            return 0
        for c, v in where.items():
            t = t.where(F.col(c) == v)
        return t.count()

    def compact(self) -> None:
        t, now = self.table(), self._generation()
        if t is None:
            return
        t.withColumn("batch", F.lit("")).write.mode("overwrite").parquet(f"{self.path}/g{now + 1}/version=0")
        for g in self._numbers(self.path, "g"):
            if g < now:
                remove(self.spark, f"{self.path}/g{g}")

    def load(self, symbol: str, timeframe: str, fetch: Callable[[], DataFrame]) -> DataFrame:
        """What the table has of the symbol, or else what ``fetch`` brings, which is then kept."""
        have = self.get(symbol, timeframe)
        if have is None or have.isEmpty():
            self.put(fetch(), timeframe)
            have = self.get(symbol, timeframe)
        return have
