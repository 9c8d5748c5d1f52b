"""Operator 12: vector codes from codebooks that Lloyd's rounds refine, with Elkan's bounds.

Components become integers, vectors are cut into equal parts and each part position has a codebook. A table keeps for every
part its entry, an upper bound of the distance to it and a lower bound of the distance to each entry of the codebook. When
entries move, the upper bound grows by how far the part's own entry moved and each lower bound shrinks by how far its entry
did. An entry is passed over if the upper bound is less than its lower bound, or less than half its distance from the part's
entry; both strictly, so that an entry as near as the best is never passed over. What remains is decided by exact integer
distances, ties to the lower index. Bounds are kept as small floats that are rounded outwards, so they hold whatever they lose.

Rows stay where they are in every round: what is shuffled is one sum and one count for each entry and task, and what the driver
holds is the codebooks, whose size doesn't depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import clean_name, look_up, prepare, table, written
from barloom.session import new_path, remove

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose bounds are in memory at once.
BLOCK = 512


def above(x: np.ndarray) -> np.ndarray:
    """Small floats not less than x."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def below(x: np.ndarray) -> np.ndarray:
    """Small floats not more than x, half as long as those of above."""
    with np.errstate(over="ignore"):
        y = np.minimum(x, 65504).astype(np.float16)
    return np.where(y > x, np.nextafter(y, np.float16(-np.inf)), y)


def roots(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of integers, not less (up) or not more than the exact ones."""
    r = np.sqrt(squared.astype(np.float64))
    return np.nextafter(r, np.inf) if up else np.maximum(np.nextafter(r, -np.inf), 0)


def squares(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of each part to each entry: (row, part, entry) for x (row, part, place), books (part, entry, place)."""
    d = x[:, :, None, :] - books[None]
    return np.einsum("rpek,rpek->rpe", d, d)


def first_assignment(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of each part: all distances are taken."""
    d = squares(x, books)
    entry = d.argmin(axis=2)
    best = np.take_along_axis(d, entry[:, :, None], axis=2)[:, :, 0]
    return entry, above(roots(best, True)), below(roots(d, False))


def next_assignment(x: np.ndarray, books: np.ndarray, moved: np.ndarray, half: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, distances taken) after the entries moved.

    moved (part, entry): not less than how far each moved. half (part, entry, entry): not more than half the distance of two.
    """
    rows, parts, entries = lower.shape
    at = np.arange(parts)[None, :]
    upper = upper.astype(np.float64) + moved[at, entry]
    lower = np.maximum(lower.astype(np.float64) - moved[None], 0)
    own = np.arange(entries)[None, None, :] == entry[:, :, None]
    near = half[at, entry]
    open_ = (upper[:, :, None] >= lower) & (upper[:, :, None] >= near) & ~own
    r, p = np.nonzero(open_.any(axis=2))
    # Only parts with an open entry take the exact distance to their own; it may close all of them.
    d = x[r, p] - books[p, entry[r, p]]
    exact = (d * d).sum(axis=1)
    upper[r, p] = roots(exact, True)
    lower[r, p, entry[r, p]] = roots(exact, False)
    k, e = np.nonzero(open_[r, p] & (upper[r, p][:, None] >= lower[r, p]) & (upper[r, p][:, None] >= near[r, p]))
    d = x[r[k], p[k]] - books[p[k], e]
    other = (d * d).sum(axis=1)
    lower[r[k], p[k], e] = roots(other, False)
    # The least of a part's open entries and its own, ties to the lower index.
    k, e, other = np.r_[k, np.arange(len(r))], np.r_[e, entry[r, p]], np.r_[other, exact]
    order = np.lexsort((e, other, k))
    first = order[np.searchsorted(k[order], np.arange(len(r)))] if len(r) else order
    entry[r, p] = e[first]
    upper[r, p] = roots(other[first], True)
    return entry, above(upper), below(lower), len(other)


def gaps(books: np.ndarray) -> np.ndarray:
    """(part, entry, entry): not more than half the distance of two entries."""
    d = books[:, :, None, :] - books[:, None, :, :]
    return roots((d * d).sum(axis=3), False) / 2 * (1 - 1e-15)


def code_type(entries: int) -> str:
    return "u1" if entries <= 256 else "<u2" if entries <= 65536 else "<u4"


def assigned(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """state (x and, from the second round on, entry, upper, lower) with entry, upper and lower for ``books``; before: the books of the state."""
    parts, entries, size = books.shape
    kept = [c for c in state.columns if c not in ("entry", "upper", "lower")]
    kind = code_type(entries)
    moved = half = None
    if before is not None:
        moved, half = roots(((books - before) ** 2).sum(axis=2), True), gaps(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                x = b.column("x").flatten().to_numpy().reshape(-1, parts, size)
                if before is None:
                    entry, upper, lower = first_assignment(x, books)
                else:
                    old = [np.frombuffer(b"".join(b.column(c).to_pylist()), t).reshape(-1, *s) for c, t, s in (("entry", kind, (parts,)), ("upper", "<f4", (parts,)), ("lower", "<f2", (parts, entries)))]
                    entry, upper, lower, _ = next_assignment(x, books, moved, half, old[0].astype(np.int64), old[1], old[2])
                new = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (entry.astype(kind), upper.astype("<f4"), lower.astype("<f2"))]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, names=[*kept, "entry", "upper", "lower"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields if f.name in kept)
    return state.mapInArrow(run, f"{schema}, entry binary, upper binary, lower binary")


def replaced(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books whose entries are the floors of the means of their parts; those without parts stay. A task sends one row for each entry."""
    parts, entries, size = books.shape
    kind = code_type(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, size)
            entry = np.frombuffer(b"".join(b.column("entry").to_pylist()), kind).reshape(-1, parts).astype(np.int64)
            slot = (entry + np.arange(parts) * entries).ravel()
            count += np.bincount(slot, minlength=parts * entries)
            np.add.at(total, slot, x)
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    sums = state.select("x", "entry").mapInArrow(run, "slot long, n long, total array<bigint>")
    wide = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(size)]
    out = books.copy()
    for r in sums.groupBy("slot").agg(F.sum("n").alias("n"), *wide).collect():  # one row for each entry
        out[r.slot // entries, r.slot % entries] = [int(r[f"t{k}"]) // r.n for k in range(size)]
    return out


def usable(df: DataFrame, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """df with x, the integer components, of the rows whose vector takes part; and the number of components (0: no rows)."""
    v, x = clean_name(df, "v"), clean_name(df, "x")
    wide = df.withColumn(v, F.transform(F.col(vector_col), lambda c: c.cast("double")))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = wide.where(F.col(v).isNotNull() & ~bad)
    largest = F.max(F.array_max(F.transform(v, lambda c: F.abs(c))))
    sizes = good.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("most")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = sizes[0]["d"] if sizes else 0
    # Sums of squares, of as many components as a vector has, stay in 64 bits.
    if dims and (2 * (sizes[0]["most"] * scale + 1)) ** 2 * dims >= 2**62:
        raise ValueError(f"components up to {sizes[0]['most']} are too large for 64-bit squared distances at scale {scale}")
    return good.where(F.size(v) == dims).withColumn(x, F.transform(v, lambda c: F.floor(c * scale))).drop(v), dims


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, entry, error) of each usable row, a written table, and the books (part, entry, place).

    entry is binary, the index of each part's entry in part order; error is the squared distance of the vector to them. The
    books start as the parts of the ``entries`` rows with the smallest ids (rows without an id last, equal ids by their
    components), or of all, if there are fewer. Null vectors and those with null or non-finite components are left out, and so are
    those of another length than the most common; that length must be a multiple of ``parts``. Rows without an id or a label
    take part like others, repeated rows count each time, other columns don't matter. An empty table gives an empty one.
    """
    spark = df.sparkSession
    prepare(spark)
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows, dims = usable(named, "vector", scale)
    rows = rows.select("vec_id", "label", "x")
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    kinds = "vec_id long, label " + named.schema["label"].dataType.simpleString() + ", entry binary, error long"
    if not dims:
        return spark.createDataFrame([], kinds), np.zeros((parts, 0, 0), np.int64)
    rows = written(rows, "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    state, before = rows, None
    past = None
    for _ in range(rounds):
        path = new_path(spark, "barloom/bounds")
        state = written(assigned(state, books, before), "bounds", path)
        before, books = books, replaced(state, books)
        if past:  # nothing reads the round before any more
            remove(spark, past)
        past = path
    final = assigned(state, books, before)
    kind = code_type(books.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, *books.shape[::2])
            entry = np.frombuffer(b"".join(b.column("entry").to_pylist()), kind).reshape(-1, parts)
            d = x - books[np.arange(parts)[None, :], entry]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("entry"), pa.array((d * d).sum(axis=(1, 2)))], names=["vec_id", "label", "entry", "error"])

    return written(final.select("vec_id", "label", "x", "entry").mapInArrow(run, kinds), "codes"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over all rows of the label; rows without a label are one group."""
    key = F.to_json(F.struct("label"))  # '{}' without a label
    sums = written(coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    return look_up(coded, key, sums, "key", "n", F.col("vec_id"))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("entry")).alias("code")
    return with_label_error(coded).select("vec_id", code, "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> str:
    def assign(books: str) -> str:
        """Each part's nearest entry with its squared distance."""
        return f"""SELECT r, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT c.r, c.p, c.x, b.e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM cut c JOIN {books} b USING (p)) GROUP BY r, p"""

    def replace(books: str, near: str) -> str:
        mean = "list(m ORDER BY k)"
        return f"""SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM {books} b LEFT JOIN (
            SELECT p, e, {mean} AS x FROM (
              SELECT p, e, k, (sum(v)::BIGINT - ((sum(v)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (
                SELECT p, best.e AS e, unnest(x) AS v, unnest(range(len(x))) AS k FROM {near}) GROUP BY p, e, k) GROUP BY p, e) n USING (p, e)"""

    return f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cut AS (
  SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM whole, range({parts}) t(p)
), b0 AS (SELECT p, r AS e, x FROM cut WHERE r < {entries}),
a0 AS MATERIALIZED ({assign("b0")}), b1 AS MATERIALIZED ({replace("b0", "a0")}),
a1 AS MATERIALIZED ({assign("b1")}), b2 AS MATERIALIZED ({replace("b1", "a1")}),
a2 AS MATERIALIZED ({assign("b2")}), coded AS (
  SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded JOIN whole USING (r)
"""


OP12_SQL = _sql()
