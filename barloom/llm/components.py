"""Connected components of a table of links, by alternating star contractions.

All state is in tables of the shared folder: nothing about single documents reaches the driver, and a lost executor costs
no more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import look_up, written
from barloom.session import new_path, remove


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link that isn't the least of its component; root is the least node reachable.

    Links with a null end, of a node to itself and repeated ones don't matter. Without links the result is empty. A node
    with very many links is looked up by broadcast, so its links stay spread over tasks. The tables of a round are
    removed once the next one is written.
    """
    spark = links.sparkSession
    old: list[str] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        old.append(new_path(spark, f"barloom/{what}"))
        return written(df, what, old[-1])

    def with_least(edges: DataFrame) -> DataFrame:
        """edges (u, v) with m, the least v of each u."""
        least = kept(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "w"), "least")
        return look_up(edges, F.col("u"), least, "w", "n", F.col("v"))

    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = kept(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        past, old = old, []
        # Large star: every larger neighbour is tied to the least one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        edges = kept(near.distinct(), "links")
        # Small star: the node and its smaller neighbours are tied to the least one.
        near = with_least(edges)
        tied = near.select("u", F.col("m").alias("v")).unionByName(near.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = kept(tied.distinct(), "links")
        for path in past:
            remove(spark, path)
