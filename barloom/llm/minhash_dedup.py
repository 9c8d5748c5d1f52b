"""Operator 13: MinHash near-duplicates, verified through odd sketches.

1. Each whole text becomes its set of shingles, the set's MinHash sample, the keys of BANDS bands of the sample and the odd
   sketch of all of it. Equal sets are one from here on.
2. Sets that share a band key are candidates. Within a key sketches are compared: pairs that differ in more bits than
   similar sets do (but for one in 10 ** 10) are none. What remains ties sets to clusters: no link leaves a cluster.
3. Whole sets are gathered for clusters only, and links are confirmed on them, exactly.

Neither step needs every pair: only which sets hang together matters, so pairs already tied are passed over, and links are
returned that span. Groups (keys, clusters) that are too large for a task are dealt to parts. Each part ties its own rows;
after that only rows outside the group's largest piece are compared with all parts, in blocks. A ball of near copies is one
piece by then, so that a group costs about its size, not its square, unless most of it isn't linked at all.

A pair at the threshold shares no band with a probability of (1 - 0.85 ** 4) ** 32 = 6e-11, more similar ones with less.
Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import BROADCAST_ROWS, add_columns, column, look_up, prepare, table, written
from barloom.llm.components import components
from barloom.llm.odd_sketch import BITS, band_keys, differing, minhashes, most_bits, odd_sketches, shingle_set

PERCENT, BANDS, ROWS = 85, 32, 4
#: Rows of a part of a group, and members of sets in it: what a task holds of a group.
PART, PART_MEMBERS = 1024, 1 << 20
#: Rows of a part that are compared with others at once.
STRIP = 128


class Ties:
    """Which of n rows hang together."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, k: int, others: np.ndarray) -> None:
        old = np.unique(np.append(self.root[others], self.root[k]))
        self.root[np.isin(self.root, old)] = old[0]


def _alike(cells: dict[str, np.ndarray], strip: slice, right: slice, limit: int, percent: int) -> np.ndarray:
    """(row of strip, row of right): sketches and sizes allow the similarity."""
    sketch, n = cells["sketch"], cells["n"]
    ok = differing(sketch[strip, None], sketch[None, right]) <= limit
    a, b = n[strip, None], n[None, right]
    return ok & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def tie_by_set(sets: list[np.ndarray], ties: Ties, near: Callable, percent: int) -> None:
    """Ties rows whose sets have the similarity; of pairs that the sketches allow those that aren't tied yet are confirmed."""
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(code.max(initial=-1) + 1, bool)
    for k, others in near():
        own = code[start[k] : start[k + 1]]
        mark[own] = True
        # A few at a time: once tied to a piece, its other rows needn't be looked at.
        step = 16
        while len(others := others[ties.root[others] != ties.root[k]]):
            some, others = others[:step], others[step:]
            ends = np.cumsum(size[some])
            at = np.arange(ends[-1]) + np.repeat(start[some] - np.r_[0, ends[:-1]], size[some])
            both = np.add.reduceat(mark[code[at]].astype(np.int64), np.r_[0, ends[:-1]])
            linked = some[100 * both >= percent * (size[k] + size[some] - both)]
            if len(linked):
                ties.tie(k, linked)
            step *= 2
        mark[own] = False


def cell_links(cells: dict, percent: int, limit: int) -> list[tuple[int, int]]:
    """Links (node, other) that span what hangs together in a cell.

    cells: arrays by name - node, n, sketch, asks, piece and, to confirm links, set. Where no row asks, all pairs count. Where
    some do, pairs of one that asks and one that doesn't, of different pieces.
    """
    node, asks, piece = cells["node"], cells["asks"], cells["piece"]
    if asks.any():
        order = np.argsort(~asks, kind="stable")
        cells = {c: [v[k] for k in order] if isinstance(v, list) else v[order] for c, v in cells.items()}
        node, piece, first = cells["node"], cells["piece"], int(asks.sum())
    else:
        first = None
    n = len(node)
    ties = Ties(n)
    for p in np.unique(piece) if first is not None else ():
        same = np.flatnonzero(piece == p)
        ties.root[same] = same[0]

    def near() -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, n if first is None else first, STRIP):
            strip = slice(a, min(n if first is None else first, a + STRIP))
            right = slice(0, strip.stop) if first is None else slice(first, n)
            for k, ok in enumerate(_alike(cells, strip, right, limit, percent), a):
                others = np.flatnonzero(ok) + right.start
                others = others[others < k] if first is None else others
                others = others[ties.root[others] != ties.root[k]]
                if len(others):
                    yield k, others

    before = ties.root.copy()
    if "set" in cells:
        tie_by_set(cells["set"], ties, near, percent)
    else:
        for k, others in near():
            ties.tie(k, others)
    # A link for each piece that was tied to another, not for each of its rows.
    heads = np.unique(before)
    moved = heads[ties.root[heads] != heads]
    return [(int(node[k]), int(node[ties.root[k]])) for k in moved]


def spanning_links(rows: DataFrame, percent: int, limit: int, part: int = PART, members: int = PART_MEMBERS) -> DataFrame:
    """rows: a written table (grp, node, n, sketch and maybe set) of groups with more than one row. Links (a, b), a written table."""
    confirm = "set" in rows.columns
    cost = F.sum("n") if confirm else F.lit(0)
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), cost.alias("c"))
    groups = written(groups.select(F.col("grp").alias("g"), "m", F.greatest(F.ceil(F.col("m") / part), F.ceil(F.col("c") / members)).cast("int").alias("parts")), "groups")
    payload = ["node", "n", "sketch"] + ["set"] * confirm
    first = look_up(rows, F.col("grp"), groups, "g", "m", F.col("node"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    no = F.lit(False)
    zero = F.lit(0).cast("long")
    made = first.select("grp", own.alias("i"), F.lit(0).alias("j"), no.alias("asks"), zero.alias("piece"), *payload)
    links = written(_in_cells(made, confirm, percent, limit), "links")
    large = written(groups.where("parts > 1"), "large")
    n_large = large.count()
    if not n_large:
        return links
    few = F.broadcast if n_large <= BROADCAST_ROWS else lambda d: d
    parted = rows.join(few(large.select("g", "parts")), F.col("grp") == F.col("g")).drop("g")
    named = parted.join(components(links, "a", "b").withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
    named = written(named.withColumn("piece", F.coalesce("root", "node")).drop("x", "root"), "named")
    pieces = named.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("k"))
    largest = written(pieces.groupBy("grp").agg(F.max(F.struct("k", "piece")).alias("top"), F.sum("k").alias("m")), "pieces")
    # Rows outside the largest piece ask; they come in blocks, and each block meets every part.
    rest = largest.select(F.col("grp").alias("g"), F.col("top.piece").alias("top"), F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("top.k")) / part)).cast("int").alias("blocks"), F.col("m").alias("w"))
    named = named.join(few(rest.drop("w")), F.col("grp") == F.col("g")).drop("g")
    count_up = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = named.withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).withColumn("j", count_up(F.col("blocks"))).withColumn("asks", no)
    asking = named.where(F.col("piece") != F.col("top")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    asking = asking.withColumn("i", count_up(F.col("parts"))).withColumn("asks", F.lit(True))
    names = ["grp", "i", "j", "asks", "piece", *payload]
    more = _in_cells(every.select(*names).unionByName(asking.select(*names)), confirm, percent, limit, asked=True)
    return written(links.unionByName(more).distinct(), "links")


def _in_cells(made: DataFrame, confirm: bool, percent: int, limit: int, asked: bool = False) -> DataFrame:
    """Links (a, b) of the cells (grp, i, j) of made, a cell at a time. asked: cells where no row asks have no links."""
    prepare(made.sparkSession)
    dealt = made.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        asks = t["asks"].to_numpy()
        if t.num_rows < 2 or asked and (not asks.any() or asks.all()):
            return
        cells = {c: t[c].to_numpy() for c in ("node", "n", "piece")} | {"asks": asks}
        cells["sketch"] = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        if confirm:
            cells["set"] = [np.frombuffer(s, np.uint64) for s in t["set"].to_pylist()]
        if found := cell_links(cells, percent, limit):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            key = [b.column(c).to_numpy() for c in ("grp", "i", "j")]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            cuts = np.r_[0, change, b.num_rows]
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == e:
                    continue
                cell = tuple(int(k[a]) for k in key)
                if cell != now and held:
                    yield from links(held)
                    held = []
                now = cell
                held.append(b.slice(a, e - a))
        if held:
            yield from links(held)

    return dealt.mapInArrow(run, "a long, b long")


def with_shingles(df: DataFrame, text_col: str, sample: bool) -> DataFrame:
    """df with key (128 bits of the set; null if empty), n, and either keys and sketch, or the set itself."""

    def make():
        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingle_set(t) for t in column(b, text_col).to_pylist()]
            out = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            if not sample:
                return [*out, pa.array([s.tobytes() for s in sets], pa.binary())]
            least = minhashes(sets)
            keys = band_keys(least, BANDS, ROWS).view(np.int64)
            return [*out, pa.array(list(keys), pa.list_(pa.int64())), pa.array([s.tobytes() for s in odd_sketches(least, BITS)], pa.binary())]

        return fn

    more = [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())] if sample else [T.StructField("set", T.BinaryType())]
    return add_columns(df, [T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), *more], make)


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, part: int = PART, members: int = PART_MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    component_id is the smallest id reachable over sets of shingles whose intersection has at least ``percent`` hundredths of
    their union. Texts that are null or have no word have an empty set and are linked with nothing, not even each other: their
    component is their own id. Rows without an id link nothing: they have the component of an equal set, or null. Rows that
    share an id are linked by their texts only. Repeated rows are repeated; an empty table gives an empty one. Columns of docs
    besides id and text don't matter.
    """
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(with_shingles(one, "text", True).drop("text"), "prints")
    same = prints.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # Nodes are numbered once, in a written table; the numbers mean nothing.
    sets = written(same.withColumn("node", F.monotonically_increasing_id()), "sets")
    linking = sets.where(F.col("least").isNotNull())

    limit = most_bits(percent / 100)
    keyed = linking.select("node", F.explode("keys").alias("grp"))
    shared = written(keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("grp").alias("g"), "m", F.lit(True).alias("is_shared")), "shared")
    keyed = look_up(keyed, F.col("grp"), shared, "g", "m", F.col("node")).where("is_shared").drop("is_shared")
    rows = written(keyed.join(linking.select("node", "n", "sketch"), "node"), "keyed")
    clusters = components(spanning_links(rows, percent, limit, part), "a", "b")
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())

    # Texts are read again for the sets in clusters, found by an id that has them.
    wanted = written(linking.join(clusters, "node").select(F.col("least").alias("id"), F.col("key").alias("own"), "node", "root", "sketch"), "wanted")
    few = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda d: d
    again = one.join(few(wanted.select("id").distinct()), F.col("doc_id") == F.col("id"), "left_semi")
    again = with_shingles(again, "text", False).drop("text")
    whole = again.join(few(wanted), (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("own")))
    # Rows that share id and text meet as one row for each task.
    whole = whole.groupBy("node").agg(*[F.first(c).alias(c) for c in ("root", "n", "sketch", "set")])
    whole = written(whole.withColumnRenamed("root", "grp"), "whole")
    roots = components(spanning_links(whole, percent, limit, part, members), "a", "b")

    named = sets.join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").withColumn("head", F.coalesce("root", "node"))
    sizes = written(named.groupBy("head").agg(F.count(F.lit(1)).alias("m"), F.min("least").alias("component_id")).where("m > 1").withColumnRenamed("head", "h"), "sizes")
    named = look_up(named.select("key", "least", "copies", "head"), F.col("head"), sizes, "h", "m", F.col("key"))
    named = written(named.select(F.col("key").alias("k"), "copies", F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("known")), "named")
    # Large groups of copies share a key: such a key's rows stay where they are.
    out = look_up(prints.select("doc_id", "key", "n"), F.col("key"), named, "k", "copies", F.col("doc_id"))
    own = F.when(F.col("known").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op13_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = shingle_groups(table(spark, sf_dir, "documents"))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
