"""Series thinned to a width, by places in the whole series that no task has to number.

Rows are numbered within slices of time, and slices begin where the counts of those before them end; only one row for each
slice goes through a window of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a drawing or a document takes.
WIDTH = 600


def placed(df: DataFrame, key: str, order: str, slices: Column) -> DataFrame:
    """df with place, from 0 in order of ``order`` in each key, and rows, how many its key has.

    slices must not fall as order grows, such as a date of a time; rows of one time come in any order, but in one slice.
    """
    s = df.withColumn("_slice", slices)
    counts = s.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "rows": F.sum("_in").over(Window.partitionBy(key))})
    own = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(order)) - 1
    out = s.withColumn("_own", own).join(counts.drop("_in"), [key, "_slice"])
    return out.withColumn("place", F.col("_before") + F.col("_own")).drop("_slice", "_own", "_before")


def strided(df: DataFrame, key: str, order: str, slices: Column, width: int = WIDTH) -> DataFrame:
    """At most ``width`` rows of each key, equally far apart, the last one among them."""
    p = placed(df, key, order, slices)
    step = F.ceil(F.col("rows") / width)
    return p.where((F.col("rows") - 1 - F.col("place")) % step == 0)


def bucket_means(df: DataFrame, key: str, order: str, value: str, slices: Column, width: int = WIDTH) -> DataFrame:
    """(key, bucket, order, value, n): means of at most ``width`` buckets of each key, with the last ``order`` of each.

    Bucket b begins at place floor(b * rows / width); keys with no more rows than that have a bucket for each. A mean keeps
    something of a spike that a stride would pass over.
    """
    p = placed(df.select(key, order, value), key, order, slices)
    bucket = F.expr(f"((place + 1) * least(rows, {width}L) + rows - 1) div rows - 1")
    return p.groupBy(key, bucket.alias("bucket")).agg(F.max(order).alias(order), F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
