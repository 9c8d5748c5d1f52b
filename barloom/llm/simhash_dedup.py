"""Operator 5: SimHash near-duplicates through BK-trees.

Two fingerprints that differ in at most RADIUS bits agree in all bits of at least BLOCKS - RADIUS of BLOCKS bit blocks.
So every choice of that many blocks makes shards: the fingerprints with equal bits there. Each shard has a BK-tree, whose
children hang on edges that carry their distance to the parent; a search follows only edges within the radius. A shard of
more than SHARD fingerprints is split by further blocks of the bits that it doesn't share yet, as long as that leaves
fewer pairs to look at. Where it doesn't - dense balls of near copies - the trees of the shard's parts are searched with
the other parts' fingerprints, each pair of parts in a task of its own. Equal fingerprints are one before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import BROADCAST_ROWS, HOT_KEYS, add_columns, clean_name, column, look_up, prepare, table, written
from barloom.llm.components import components
from barloom.llm.simhash import BITS, fingerprint

RADIUS, SHARD = 4, 2048


class BKTree:
    """Distinct 64-bit fingerprints under the Hamming distance."""

    def __init__(self):
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if not self.value:
            self.value.append(x)
            self.child.append({})
            return
        at = 0
        while True:
            d = (self.value[at] ^ x).bit_count()
            if not d:
                return
            below = self.child[at].get(d)
            if below is None:
                self.child[at][d] = len(self.value)
                self.value.append(x)
                self.child.append({})
                return
            at = below

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Places of the values at most radius from x."""
        stack = [0] if self.value else []
        while stack:
            at = stack.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                yield at
            edges = self.child[at]
            if len(edges) <= 2 * radius + 1:
                stack += [n for e, n in edges.items() if d - radius <= e <= d + radius]
            else:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]


def shard_links(left: list[tuple[int, int]], right: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius, as (larger id, smallest id of its group); none is needed twice.

    left, right: (fingerprint, id). With right, pairs of one of each are looked for; without, pairs within left.
    """
    items = left + (right or [])
    up = list(range(len(items)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(a: int, b: int) -> None:
        a, b = top(a), top(b)
        if a != b:
            if items[a][1] > items[b][1]:
                a, b = b, a
            up[b] = a

    tree, place = BKTree(), []
    for k, (fp, _) in enumerate(left):
        if right is None:
            for at in tree.within(fp, radius):
                join(place[at], k)
        tree.add(fp)
        if len(tree.value) > len(place):
            place.append(k)
    for k, (fp, _) in enumerate(right or [], len(left)):
        for at in tree.within(fp, radius):
            join(place[at], k)
    return [(items[k][1], items[top(k)][1]) for k in range(len(items)) if top(k) != k]


def block_count(n: int, radius: int) -> int:
    """Bit blocks such that n random fingerprints leave a few in each shard; two more than the radius at least."""
    m = radius + 2
    while m < radius + 8 and n >> (BITS * (m - radius) // m) > 8:
        m += 1
    return m


@cache
def choices(taken: int, blocks: int, radius: int) -> list[int]:
    """Masks that each hold the bits ``taken`` and a choice of all but ``radius`` of ``blocks`` blocks of the other bits."""
    free = [k for k in range(BITS) if not taken >> k & 1]
    cut = [len(free) * k // blocks for k in range(blocks + 1)]
    part = [sum(1 << k for k in free[a:b]) for a, b in zip(cut, cut[1:])]
    return [taken | sum(chosen) for chosen in combinations(part, blocks - radius)]


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def deeper(hot: DataFrame, radius: int) -> DataFrame:
    """hot (key, taken, fp, rep), shards that are too large, as (above, key, taken, fp, rep): smaller ones, above being the key they come from.

    A shard whose free bits are too few for blocks has no smaller ones.
    """
    blocks, full = radius + 2, (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above, taken, fp, rep = (b.column(k).to_numpy() for k in range(4))
            for t in np.unique(taken).tolist():
                own = taken == t
                if BITS - (t & full).bit_count() < blocks:
                    continue
                for mask in choices(t & full, blocks, radius):
                    m = np.int64(signed(mask))
                    # A shard below is known by the one above, the bits it shares and their values.
                    cols = above[own], fp[own] & m, np.full(own.sum(), m), fp[own], rep[own]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["above", "bits", "taken", "fp", "rep"])

    out = hot.select("key", "taken", "fp", "rep").mapInArrow(run, "above long, bits long, taken long, fp long, rep long")
    return out.select("above", F.xxhash64("above", "taken", "bits").alias("key"), "taken", "fp", "rep")


def near_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """prints: distinct (fp, rep), a written table. Links (a, b) between reps that connect all within the radius.

    A shard's key is a hash of its bits; shards that meet under one key only make a tree larger, as distances decide.
    """
    prepare(prints.sparkSession)
    masks = [signed(m) for m in choices(0, block_count(prints.count(), radius), radius)]
    keys = [F.struct(F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(m)).alias("key"), F.lit(m).alias("taken")) for m in masks]
    keyed = prints.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.taken", "fp", "rep")
    zero = F.lit(0).cast("long")
    done = []

    def part_of(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "key", how)

    while True:
        hot = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard), "hot")
        if hot.isEmpty():
            done.append(keyed.select("key", zero.alias("i"), zero.alias("j"), zero.alias("part"), "fp", "rep"))
            break
        done.append(part_of(keyed, hot.select("key"), "left_anti").select("key", zero.alias("i"), zero.alias("j"), zero.alias("part"), "fp", "rep"))
        large = written(part_of(keyed, hot, "inner").select("key", "taken", "fp", "rep", "n"), "large")
        below = written(deeper(large, radius), "below")
        pairs = below.groupBy("above", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("above").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
        split = hot.join(pairs, F.col("key") == F.col("above")).where(F.col("pairs") * 2 < F.col("n") * F.col("n")).select("key")
        split = written(split, "split")
        # What further blocks don't part meets in pairs of parts.
        whole = part_of(large, split, "left_anti").withColumn("parts", F.ceil(F.col("n") / shard))
        part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))
        whole = whole.select("key", "fp", "rep", part.alias("part"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("other"))
        done.append(whole.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "rep"))
        keyed = below.join(F.broadcast(split) if split.count() <= BROADCAST_ROWS else split, F.col("above") == split["key"], "left_semi").select("key", "taken", "fp", "rep")
    keyed = done[0]
    for df in done[1:]:
        keyed = keyed.unionByName(df)
    dealt = keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << BITS) - 1

        def links(name, items) -> list[tuple[int, int]]:
            if len(items) < 2:
                return []
            _, i, j = name
            if i == j:
                return shard_links([(fp & mask, rep) for _, fp, rep in items], None, radius)
            return shard_links([(fp & mask, rep) for p, fp, rep in items if p == i], [(fp & mask, rep) for p, fp, rep in items if p == j], radius)

        now, items = None, []
        for b in batches:
            found = []
            for key, i, j, part, fp, rep in zip(*(c.to_pylist() for c in b.columns)):
                if (key, i, j) != now:
                    found += links(now, items)
                    now, items = (key, i, j), []
                items.append((part, fp, rep))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if found := links(now, items):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """df with the fingerprint of each whole text, as a signed 64-bit integer."""

    def make():
        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([signed(fingerprint(t)) for t in column(b, text_col).to_pylist()], pa.int64())]

        return fn

    return add_columns(df, [T.StructField(out, T.LongType())], make)


def _grouped(one: DataFrame, radius: int) -> DataFrame:
    """one: a written table with doc_id and fp. (doc_id, fp, root, component_id) for each row; root is the smallest fingerprint of the group."""
    prints = written(one.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "reps")
    # Fingerprints are the nodes, not ids: rows of different texts that share an id don't tie their groups together. Those
    # of rows without any id link nothing.
    nodes = prints.where(F.col("least").isNotNull()).select("fp", F.col("fp").alias("rep"))
    roots = components(near_links(nodes, radius), "a", "b")
    named = written(prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    group = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    group = written(group.where("m > 1").withColumnRenamed("root", "r"), "groups")
    named = look_up(named, F.col("root"), group, "r", "m", F.col("fp"))
    named = named.select(F.col("fp").alias("f"), "n", "root", F.coalesce("component_id", "least").alias("component_id"))
    # Empty texts and large groups of copies share a fingerprint: such a key's rows stay where they are.
    return look_up(one, F.col("fp"), written(named, "named"), "f", "n", F.col("doc_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs.

    component_id is the smallest id reachable over fingerprints that differ in at most ``radius`` bits. Texts that are
    null, empty or without words have fingerprint 0 and are linked like any other. Rows without an id link nothing: they
    have the component of an equal fingerprint, or null. Rows that share an id are linked by their texts only. Repeated
    rows are repeated; an empty table gives an empty one.
    """
    one = with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    return _grouped(written(one, "prints"), radius).drop("root")


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, few: int = BROADCAST_ROWS) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id stays, once; rows without an id stay.

    A row is told by its id and its fingerprint, as rows of different texts may share an id. Of rows that have both in
    common the first one by text, then by all its columns as JSON, stays, in whatever order they come. They meet as one row
    for each task, never all in one. Null and empty texts are one group. An empty table gives an empty one.

    Fingerprints are made once: the rows are kept with them in a table, which is read again to pick the ones that stay.
    """
    kept, kept_fp, fp, order = (clean_name(docs, x) for x in ("kept_id", "kept_fp", "fp", "order"))
    told_apart = written(with_fingerprint(docs, out=fp), "told")
    groups = _grouped(told_apart.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")), RADIUS)
    # All of a group's rows in groups have its smallest id.
    each = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("root", "fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    best = each.groupBy("root").agg(F.min(F.struct("fp", "doc_id", "n")).alias("b"))
    best = written(best.select(F.col("b.doc_id").alias(kept), F.col("b.fp").alias(kept_fp), F.col("b.n").alias("n")), "kept")

    with_id = told_apart.where(F.col("doc_id").isNotNull())
    told = (F.col("doc_id") == F.col(kept)) & (F.col(fp) == F.col(kept_fp))
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))).alias(order)
    again = best.where("n > 1")
    n_again, rows = best.agg(F.count_if(F.col("n") > 1), F.sum("n")).first()
    # Keys with over one part in HOT_KEYS of these rows are no more than that; they are looked up where their rows are.
    hot = again if n_again <= few else again.where(F.col("n") * HOT_KEYS > rows)
    hot = F.broadcast(hot.drop("n"))
    repeated = with_id.join(hot, told, "left_semi")
    rest = with_id if not n_again else with_id.join(hot, told, "left_anti")
    if n_again > few:
        cold = again.where(F.col("n") * HOT_KEYS <= rows).drop("n")
        repeated = repeated.unionByName(rest.join(cold.hint("merge"), told, "left_semi"))
    # As many rows as documents stay: both sides are shuffled, texts once.
    out = rest.join(best.where("n = 1").drop("n").hint("merge"), told, "left_semi").select(*docs.columns)
    out = out.unionByName(told_apart.where(F.col("doc_id").isNull()).select(*docs.columns))
    if n_again:
        one = repeated.groupBy("doc_id", fp).agg(first)
        out = out.unionByName(one.select(*[F.col(order)[c].alias(c) for c in docs.columns]))
    return out
