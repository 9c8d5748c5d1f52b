"""Operator 3: nearest neighbours by inner product with vantage-point trees.

Inner products become distances by one more component: a candidate x gets sqrt(M^2 - |x|^2), with M the largest norm, and
a query gets 0, so all candidates have the same norm and the nearest has the largest inner product. Candidates are dealt
to shards by a hash of their id and each shard has a tree, built once; the queries stream past it in blocks. A subtree is
passed over if the triangle inequality, tightened by 1/factor, says that it holds nothing nearer than a query's k-th so
far: factor 1 is exact, less is faster and may miss. Scores are inner products of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import prepare, table

#: Candidates in a shard, about: least and most, as a task holds one; queries searched together; vectors in a leaf.
SHARD, BLOCK, LEAF = (8192, 65_536), 2048, 128
#: Queries that pass one tree. More of them than that are dealt to several tasks for each shard, each with a tree.
PASS = 1 << 20
TASKS = 100_000
K, FACTOR = 20, 0.8


def _dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, the same for the same rows wherever they stand (a matrix product isn't)."""
    return (q * c).sum(axis=-1)


class VPTree:
    """A tree over distinct vectors. copies[i]: ids that have vector i, ascending.

    Distances are those of vectors divided by ``unit``, the largest absolute component of all, so that squares stay finite;
    top is the largest norm of such vectors.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, keep: int, unit: float = 1.0):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, which = np.unique(vectors.view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.vector = vectors[first]
        by = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[by], np.arange(len(first) + 1))
        # Of equal vectors no more than ``keep`` can be among the nearest: those with the smallest ids.
        self.copies = [ids[by[a : min(b, a + keep)]] for a, b in zip(cut[:-1], cut[1:])]
        scaled = self.vector / unit
        room = np.sqrt(np.maximum(top * top - (scaled * scaled).sum(axis=1), 0))
        self.point = np.concatenate([scaled, room[:, None]], axis=1)
        self.root = self._build(np.arange(len(first)))

    def _build(self, at: np.ndarray):
        """A leaf (places), or (vantage point, radius, inside, outside)."""
        if len(at) <= LEAF:
            return at
        seen = self.point[at]
        # The vantage point is the one farthest from the middle: distances from there spread most.
        pivot = int(at[((seen - seen.mean(axis=0)) ** 2).sum(axis=1).argmax()])
        d = np.sqrt(((seen - self.point[pivot]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        return pivot, float((d[order[half - 1]] + d[order[half]]) / 2), self._build(at[order[:half]]), self._build(at[order[half:]])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, id, score) of the k nearest of each query, its own id left out."""
        # A query's length doesn't matter for which candidates are nearest.
        q = np.concatenate([queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros((len(queries), 1))], axis=1)
        norm = (self.point**2).sum(axis=1)
        qnorm = (q**2).sum(axis=1)
        room = k + 1  # a query's own vector takes a place
        best_d = np.full((len(q), room), np.inf)  # squared distances, ascending
        best_i = np.full((len(q), room), -1)
        copies = np.array([len(c) for c in self.copies])

        def leaf(at: np.ndarray, rows: np.ndarray) -> None:
            d = np.maximum(qnorm[rows, None] + norm[at][None, :] - 2 * (q[rows] @ self.point[at].T), 0)
            all_d = np.concatenate([best_d[rows], d], axis=1)
            all_i = np.concatenate([best_i[rows], np.broadcast_to(at, d.shape)], axis=1)
            pick = np.argpartition(all_d, room - 1, axis=1)[:, :room]
            pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(all_d, pick, axis=1), axis=1, kind="stable"), axis=1)
            best_d[rows], best_i[rows] = np.take_along_axis(all_d, pick, axis=1), np.take_along_axis(all_i, pick, axis=1)

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                leaf(node, rows)
                return
            pivot, radius, inside, outside = node
            d = np.sqrt(np.maximum(qnorm[rows] + norm[pivot] - 2 * (q[rows] @ self.point[pivot]), 0))
            near = d <= radius
            for these, first, second in ((near, inside, outside), (~near, outside, inside)):
                r = rows[these]
                if len(r):
                    visit(first, r)
                    gap = np.abs(d[these] - radius)
                    visit(second, r[gap <= np.sqrt(best_d[r, -1]) * factor + 1e-9])

        visit(self.root, np.arange(len(q)))
        rows, ids, scores = [], [], []
        for r in range(len(q)):
            at = best_i[r][best_i[r] >= 0]
            if not len(at):
                continue
            s = _dots(queries[r], self.vector[at])
            n = copies[at]
            i = np.concatenate([self.copies[x] for x in at])
            s = np.repeat(s, n)
            other = i != own[r]
            i, s = i[other], s[other]
            pick = np.lexsort((i, -s))[:k]
            rows.append(np.full(len(pick), r))
            ids.append(i[pick])
            scores.append(s[pick])
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): double vectors that aren't null, zero, empty or holding null or non-finite components, with an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & some)


def shape(c: DataFrame) -> list:
    """Of what usable returns the most common length d, how many have it (n), their largest norm and largest component (unit); or nothing."""
    # The largest component is a column of its own: within the fold it would be taken anew for each component.
    largest = F.col("largest")
    norm = largest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))
    wide = c.withColumn("largest", F.array_max(F.transform("v", lambda x: F.abs(x))))
    sizes = wide.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), F.max(largest).alias("unit"))
    return sizes.orderBy(F.desc("n"), "d").limit(1).collect()


def nearest_neighbours(candidates: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None, block: int = BLOCK, at_once: int = PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product with each query.

    Nearest first, ties to the smaller id; candidates with the query's own id are left out. All are returned if there are
    fewer than k. Unusable vectors (see usable) take no part; vectors must have one length, and rows with another than the
    most common are unusable too. Repeated candidate rows count once, as do repeated queries; of different vectors with one
    id the smallest counts. Empty tables give an empty one. Distances tell inner products apart that differ by more than
    about 1e-15 of the largest norm times the query's.

    A candidate goes to one task for each ``at_once`` queries, a query to one task for each ``shard`` candidates.
    """
    spark = candidates.sparkSession
    prepare(spark)
    c, q = usable(candidates, id_col, vector_col), usable(queries, id_col, vector_col)
    sizes = shape(c)
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dim, n, unit = sizes[0]["d"], sizes[0]["n"], sizes[0]["unit"]
    top = min(sizes[0]["norm"] / unit * (1 + 1e-12), dim**0.5)
    q = q.where(F.size("v") == dim)
    # Larger tables have larger shards, as every query is sent to every shard.
    shard = shard or min(SHARD[1], max(SHARD[0], n // 64))
    shards, passes = max(1, -(-n // shard)), max(1, -(-q.count() // at_once))
    home = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    count_up = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    both = (
        c.where(F.size("v") == dim).select(home(1, shards).alias("s"), count_up(passes).alias("p"), F.lit(0).alias("is_query"), "vec_id", "v")
        .unionByName(q.select(count_up(shards).alias("s"), home(2, passes).alias("p"), F.lit(1).alias("is_query"), "vec_id", "v"))
    )
    cell = (F.col("s") * passes + F.col("p")).cast("int").alias("cell")
    # A cell is a partition, up to TASKS of them.
    dealt = both.select(cell, "is_query", "vec_id", "v").repartitionById(min(shards * passes, TASKS), F.col("cell")).sortWithinPartitions("cell", "is_query", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, ids, vectors = None, None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            """Search what queries are held; the held candidates are a tree by then, or there are none."""
            if tree is not None and ids:
                one, first = np.unique(np.concatenate(ids), return_index=True)
                at, found, score = tree.search(np.concatenate(vectors)[first], one, k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(one[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])
            ids.clear()
            vectors.clear()

        asking, last = False, None
        for b in batches:
            cells, kind, vid = (b.column(x).to_numpy() for x in range(3))
            vec = b.column(3).flatten().to_numpy().reshape(-1, dim)
            cuts = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (kind[1:] != kind[:-1])) + 1, len(cells)]
            for a, e in zip(cuts[:-1], cuts[1:]):
                if a == e:
                    continue
                if cells[a] != now:
                    if asking:
                        yield from flush()
                    now, tree, asking, last = cells[a], None, False, None
                    ids.clear()
                    vectors.clear()
                if kind[a] and not asking:
                    if ids:
                        one, first = np.unique(np.concatenate(ids), return_index=True)
                        tree = VPTree(one, np.ascontiguousarray(np.concatenate(vectors)[first]), top, k + 1, unit)
                    ids.clear()
                    vectors.clear()
                    asking = True
                if asking:
                    for x in range(a, e, block):
                        y = min(e, x + block)
                        new = vid[x:y] != last  # a repeated query that the block before ended with
                        if sum(map(len, ids)) + y - x > block:
                            yield from flush()
                        ids.append(vid[x:y][new].copy())
                        vectors.append(vec[x:y][new].copy())
                        last = vid[y - 1]
                else:
                    ids.append(vid[a:e].copy())
                    vectors.append(vec[a:e].copy())
        if asking:
            yield from flush()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    # Each shard has sent k rows for a query at most; of many shards the root of their number meets first.
    if shards > k:
        w = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(int(shards**0.5)))).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
