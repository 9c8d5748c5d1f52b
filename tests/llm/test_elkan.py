"""Operator 12 against a plain loop."""

import hashlib
import math

import numpy as np
import pytest

from barloom.llm import elkan
from barloom.llm.elkan import OP12_SQL, op12_elkan_codes, vector_codes, with_label_error
from tests.compare import connect, duck_rows, spark_rows


def slow(rows, parts, entries, rounds, scale=256):
    """[(id, label, code, error, label error)] and the books, by loops over integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    cut = []
    for i, v, lab in kept:
        x = [math.floor(scale * c) for c in v]
        k = len(x) // parts
        cut.append((i, [tuple(x[p * k : p * k + k]) for p in range(parts)], lab))
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        got = [[near(p, r[1][p]) for p in range(parts)] for r in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[1][p] for r, g in zip(cut, got) if g[p] == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    out = []
    for i, x, lab in cut:
        code = [near(p, x[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e in code), sum(far(x[p], books[p][e]) for p, e in enumerate(code))))
    return sorted(((*r, sum(o[3] for o in out if o[1] == r[1])) for r in out), key=repr), books


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, X string, entry string").repartition(3)
    coded, books = vector_codes(df, **how)
    got = with_label_error(coded).selectExpr("vec_id", "label", "lower(hex(entry)) AS code", "error", "label_error").collect()
    return sorted(map(tuple, got), key=repr), books.tolist()


def clouds(rng, n, dims):
    middle = rng.integers(-3, 4, (12, dims)) / 2
    return [(int(i), [float(c) for c in np.float32(middle[rng.integers(12)] + rng.integers(-2, 3, dims) / 64)], int(rng.integers(4)) or None) for i in rng.permutation(n)]


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_rounds_against_a_plain_loop(spark, rounds):
    rows = clouds(np.random.default_rng(rounds), 150, 6)
    got, books = run(spark, rows, parts=3, entries=9, rounds=rounds)
    want, want_books = slow(rows, 3, 9, rounds)
    assert got == want and books == [[list(e) for e in b] for b in want_books]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [1.0, inf], 1), (5, [None, 1.0], None), (6, [], None), (None, [0.25, 0.25], None), (7, [-0.5, 2.0], None)]
    rows += [(1, [0.5, -0.001], 1), (8, [0.5, -0.001], 2), (8, [0.5, 0.5], 2), (9, [0.0, 0.0], 3), (10, [-1.0, 2.0], 3), (9, [0.0, 0.0], 3)]
    usable = [r for r in rows if r[1] != []]
    for entries in (2, 3, 64):
        got, books = run(spark, rows, parts=2, entries=entries, rounds=2)
        want, want_books = slow(usable, 2, entries, 2)
        assert got == want and books == [[list(e) for e in b] for b in want_books]
    empty = run(spark, [(2, None, 1)], parts=2)
    assert empty[0] == [] and run(spark, [], parts=2)[0] == []
    assert hashlib.sha256(b"").hexdigest() == elkan.books_digest(np.array(empty[1]))
    with pytest.raises(ValueError):
        run(spark, rows, parts=3)
    with pytest.raises(ValueError):
        run(spark, [(1, [1e30, 1.0], 1)], parts=2)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(9)
    middle = rng.integers(-2000, 2000, (16, 2, 4))
    x = np.concatenate([m + rng.integers(-60, 60, (50, 2, 4)) for m in middle])
    books = x[rng.choice(len(x), 16)].transpose(1, 0, 2).copy()
    entry, upper, lower = elkan.first_assignment(x, books)
    for _ in range(4):
        before = books.copy()
        for p in range(2):
            for e in range(16):
                if (entry[:, p] == e).any():
                    books[p, e] = x[entry[:, p] == e, p].sum(axis=0) // (entry[:, p] == e).sum()
        moved = elkan.roots(((books - before) ** 2).sum(axis=2), True)
        entry, upper, lower, taken = elkan.next_assignment(x, books, moved, elkan.gaps(books), entry.copy(), upper, lower)
        d = elkan.squares(x, books)
        assert (entry == d.argmin(axis=2)).all() and taken < 0.3 * d.size
        assert (upper.astype(float) ** 2 >= np.take_along_axis(d, entry[:, :, None], 2)[:, :, 0]).all()
        assert (lower.astype(float) ** 2 <= d).all()


def test_small_floats_are_rounded_outwards():
    x = np.random.default_rng(1).uniform(0, 70_000, 5000)
    assert (elkan.above(x).astype(float) >= x).all() and (elkan.below(x).astype(float) <= x).all()


def test_op12_equals_sql_and_a_plain_loop(spark, sf):
    df = op12_elkan_codes(spark, sf)
    assert spark_rows(df, df.columns) == duck_rows(connect(sf), OP12_SQL, df.columns)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:80]
    got, _ = run(spark, rows, parts=16, entries=24, rounds=2)
    assert got == slow(rows, 16, 24, 2)[0]
