"""A bar against the latest value of every other symbol, whenever that one had its bar.

The bars of all symbols have one order, by time and then by symbol. They are cut into slices of that order, each of which
ends in a map from symbol to last value. Maps are combined in order - a symbol's last value is carried over the slices that
don't have it - so every slice begins with what all symbols had before it, and is then scanned on its own: a prefix scan in
three shuffles, without a window over all bars or pairs of bars.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import materialise, ship_package

#: Bars in a slice, about; at least, as each slice also begins with a row for each symbol.
SLICE = 200_000
#: Values are held as integers of so small a unit: their sums don't depend on the order of updates.
UNIT = 10**9


class Peers:
    """The values of all symbols that have one, in order."""

    def __init__(self):
        self.of: dict[str, int] = {}
        self.sorted: list[tuple[int, str]] = []
        self.total = 0

    def set(self, symbol: str, value: float | None) -> None:
        old = self.of.pop(symbol, None)
        if old is not None:
            del self.sorted[bisect.bisect_left(self.sorted, (old, symbol))]
            self.total -= old
        if value is not None:
            new = self.of[symbol] = round(value * UNIT)
            bisect.insort(self.sorted, (new, symbol))
            self.total += new

    def view(self, symbol: str) -> tuple[int | None, int | None, float | None, float | None]:
        """Peers with a value, the symbol's place among them, their spread and mean; nulls without a value of its own."""
        own = self.of.get(symbol)
        if own is None:
            return None, None, None, None
        n = len(self.sorted)
        return n, bisect.bisect_left(self.sorted, (own, symbol)), (self.sorted[-1][0] - self.sorted[0][0]) / UNIT, self.total / n / UNIT


def peers_as_of(df: DataFrame, value: str, symbol: str = "symbol", ts: str = "ts", rows: int = SLICE) -> DataFrame:
    """df with peers, peer_place, peer_spread and peer_mean: symbols with a value just then, the row's own place among them
    (from 0, ties by symbol), the range and the mean of their values, to nine decimals.

    A symbol's value is that of its latest row in the order of ts and symbol, the row itself included; a null says that it has
    none from then on. Rows without a value have nulls. Rows without ts or symbol take no part and are left out. Repeated rows
    of a symbol and time come in the order of their values. Values are finite.
    """
    spark = df.sparkSession
    ship_package(spark)
    names = df.columns
    known = df.where(F.col(ts).isNotNull() & F.col(symbol).isNotNull())
    packed = known.select(F.col(symbol).cast("string").alias("s"), F.col(ts).alias("t"), F.col(value).cast("double").alias("m"), F.struct(*names).alias("row"))
    packed = materialise(packed, "barloom/packed")
    n = max(1, -(-packed.count() // rows))
    # Ranges of one order, as Spark deals them, kept with their number.
    sliced = packed if n == 1 else packed.repartitionByRange(n, "t", "s")
    sliced = materialise(sliced.withColumn("slice", F.spark_partition_id() if n > 1 else F.lit(0)), "barloom/sliced")
    last = sliced.groupBy("slice", "s").agg(F.max_by(F.struct("m"), F.struct("t", F.col("m").isNotNull(), "m")).alias("v"))
    reach = F.lead("slice", 1, sliced.agg(F.max("slice")).first()[0] or 0).over(Window.partitionBy("s").orderBy("slice"))
    carried = last.withColumn("to", reach).where(F.col("slice") < F.col("to"))
    carried = carried.select(F.explode(F.sequence(F.col("slice") + 1, F.col("to"))).alias("slice"), "s", F.col("v.m").alias("m")).where("m IS NOT NULL")
    empty = [F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in ("t", "row")]
    both = sliced.select("slice", F.lit(True).alias("given"), "t", "s", "m", "row").unionByName(carried.select("slice", F.lit(False).alias("given"), "s", "m", *empty))
    dealt = both.repartition("slice").sortWithinPartitions("slice", "given", "t", "s", F.col("m").isNotNull(), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, peers = None, Peers()
        for b in batches:
            out = []
            for at, given, s, m in zip(*(b.column(c).to_pylist() for c in ("slice", "given", "s", "m"))):
                if at != now:
                    now, peers = at, Peers()
                peers.set(s, m)
                if given:
                    out.append(peers.view(s))
            if out:
                kept = b.column("row").filter(b.column("given"))
                made = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([kept, *made], names=["row", "peers", "peer_place", "peer_spread", "peer_mean"])

    new = [T.StructField("peers", T.LongType()), T.StructField("peer_place", T.LongType()), T.StructField("peer_spread", T.DoubleType()), T.StructField("peer_mean", T.DoubleType())]
    out = dealt.mapInArrow(run, T.StructType([packed.schema["row"], *new]))
    return out.select(*[F.col("row")[c].alias(c) for c in names], *[f.name for f in new])
