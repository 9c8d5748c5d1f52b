"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import materialise, ship_package

#: Bytes that an Arrow batch holds at most, unless one row has more: a Python worker's share of memory stays small
#: whatever rows a table has. It is the one setting of the session that operators change, always to this value.
BATCH_BYTES = "8m"
#: A table of a few short columns is broadcast if it has at most so many rows; beyond that both sides are shuffled.
BROADCAST_ROWS = 100_000
#: Keys that hold over one part in so many of all rows are hot; there are no more of them than that.
HOT_KEYS = 10_000


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and bound the bytes of Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    return materialise(df, f"barloom/{what}", path)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name, whose case doesn't matter, as in Spark."""
    return batch.column([n.lower() for n in batch.schema.names].index(name.lower()))


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """df with new columns computed from Arrow batches; those of the same names, in whatever case, are replaced.

    ``make`` runs once in each task, so models are loaded there; what it returns maps a batch to the arrays of ``fields``.
    """
    prepare(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [(k, f) for k, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    names = [f.name for _, f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for b in batches:
            fn = fn or make()
            yield pa.RecordBatch.from_arrays([b.column(k) for k, _ in kept] + fn(b), names=names)

    return df.mapInArrow(run, T.StructType([f for _, f in kept] + fields))


def clean_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = "_" + base
    return base


def look_up(left: DataFrame, key: Column, right: DataFrame, right_key: str, n: str, spread: Column, few: int = BROADCAST_ROWS, hot: int = HOT_KEYS) -> DataFrame:
    """left with right's other columns (null where no key matches), right having a row for each key, with names left lacks.

    n is right's column with the rows of left that have the key; it isn't kept. If right has at most ``few`` rows it is
    broadcast. Otherwise the keys that hold over one part in ``hot`` of those rows are - no more than ``hot`` of them can -
    and their rows, like those without a key, are dealt by ``spread`` while the rest is shuffled by key. So no task gets
    a hot key's rows.
    """
    others = [c for c in right.columns if c not in (right_key, n)]
    rk, hk, salt, side = (clean_name(left, x) for x in ("_rk", "_hk", "_salt", "_side"))
    pack = lambda d, k: d.select(F.col(right_key).alias(k), F.struct(*others).alias(k + "v"))
    if right.count() <= few:
        out = left.join(F.broadcast(pack(right, rk)), key == F.col(rk), "left")
        return out.select(*left.columns, *[F.col(rk + "v")[c].alias(c) for c in others])
    total = right.agg(F.sum(n)).first()[0]
    is_hot = F.col(n) * hot > total
    out = left.join(F.broadcast(pack(right.where(is_hot), hk)), key == F.col(hk), "left")
    out = out.withColumn(salt, F.when(F.col(hk).isNull() & key.isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30))).cast("long"))
    cold = pack(right.where(~is_hot), rk).withColumn(side, F.lit(0).cast("long"))
    out = out.join(cold, (key == F.col(rk)) & (F.col(salt) == F.col(side)), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(hk + "v")[c], F.col(rk + "v")[c]).alias(c) for c in others])


def crc_mod(col, n: int):
    """crc32 of an id as text, modulo n: how rows are held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")) % n
