"""Operator 13 against all pairs of sets."""

import re

import numpy as np
import pytest

from barloom.llm import minhash_dedup, odd_sketch
from barloom.llm.minhash_dedup import op13_odd_minhash, shingle_groups
from tests.llm.helpers import ROWS, docs


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or ({" ".join(words)} if words else set())


def slow_groups(rows):
    """[(id, size, component)] of (id, text) rows. Rows that share an id are told apart by their texts."""
    sets = [frozenset(slow_set(t)) for _, t in rows]
    nodes = list({s for s, (d, _) in zip(sets, rows) if s and d is not None})
    up = {s: s for s in nodes}

    def top(s):
        while up[s] != s:
            s = up[s]
        return s

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if 100 * len(a & b) >= 85 * len(a | b):
                up[top(a)] = top(b)
    least = {}
    for s, (d, _) in zip(sets, rows):
        if s and d is not None:
            least[top(s)] = min(d, least.get(top(s), d))
    return sorted(((d, len(s), d if not s else least[top(s)] if s in up else None) for s, (d, _) in zip(sets, rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(rng, groups, each, words, swaps):
    rows = []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in rng.integers(0, 900, words)]
        for _ in range(each):
            text = list(base)
            for k in rng.integers(0, words, rng.integers(0, swaps)):
                text[k] = f"v{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(text)))
    return [(int(k), rows[i][1]) for i, k in enumerate(rng.permutation(len(rows)))]


def test_sets_and_their_sketches():
    for t in [r[1] for r in ROWS] + ["One", "a b", "a b c", "A B c\x0bd\x1ce\xa0f", "x x x x x"]:
        assert len(odd_sketch.shingle_set(t)) == len(slow_set(t))
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 5, 40_000, 300, 17_000)]
    least = odd_sketch.minhashes(sets)
    assert (least[0] == ~np.uint64(0)).all()
    for f in (0, 7, 255):
        for s, m in zip(sets[1:], least[1:]):
            assert m[f] == ((s ^ odd_sketch._SEEDS[0, f]) * odd_sketch._SEEDS[1, f]).min()
    assert (odd_sketch.minhashes(sets[3:4])[0] == least[3]).all()


@pytest.mark.parametrize("similar", [0.97, 0.85, 0.6])
def test_sketches_estimate_similarity(similar):
    rng = np.random.default_rng(int(similar * 100))
    m, off = 500, []
    for _ in range(60):
        u = rng.integers(0, 1 << 63, m).astype(np.uint64)
        both, one = u[: int(m * similar)], (m - int(m * similar)) // 2
        pair = odd_sketch.odd_sketches(odd_sketch.minhashes([np.r_[both, u[len(both) : len(both) + one]], np.r_[both, u[len(both) + one :]]]))
        bits = int(odd_sketch.differing(pair[0], pair[1]))
        off.append(odd_sketch.similarity(bits) - similar)
        assert similar < 0.85 or bits <= odd_sketch.most_bits(0.85)
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06
    assert odd_sketch.similarity(0) == 1 and odd_sketch.similarity(512) == 0
    assert odd_sketch.most_bits(0.95) < odd_sketch.most_bits(0.85) < 256


@pytest.mark.parametrize("part, members", [(1024, 1 << 20), (16, 1 << 20), (1024, 500)])
def test_groups_against_all_pairs(spark, part, members):
    """One task for a group, and groups dealt to parts of which only what isn't in the largest piece asks."""
    rows = near_copies(np.random.default_rng(part), 4, 60, 60, 7) + [(1000 + k, f"only text number {k} of its kind") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_groups(rows)
    assert 10 < len({c for _, _, c in want}) < 200
    assert got(shingle_groups(df, part=part, members=members)) == want


def test_a_ball_in_which_little_is_linked(spark):
    rows = near_copies(np.random.default_rng(3), 1, 150, 80, 22)
    want = slow_groups(rows)
    assert len({c for _, _, c in want}) > 20
    assert got(shingle_groups(spark.createDataFrame(rows, "doc_id long, text string"), part=20)) == want


def test_links_at_the_threshold(spark):
    """17 of 20 is linked, 16 of 19 is not; a chain links its ends."""
    text = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, text(0, 20)), (2, text(0, 19) + " x"), (3, text(100, 122)), (4, text(100, 119)), (5, text(200, 221)), (6, text(200, 218)), (7, text(300, 340)), (8, text(302, 342)), (9, text(304, 344))]
    assert got(shingle_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_groups(rows)
    assert {c for d, _, c in slow_groups(rows) if d in (3, 4, 5, 6)} == {3, 5, 6} and {c for d, _, c in slow_groups(rows) if d > 6} == {7}


def test_odd_rows(spark):
    rows = [*ROWS, (3, "The quick brown fox jumps over the lazy dog, and the dog sleeps.", None, None, 1, None, None), (None, "nowhere else is this", None, None, 1, None, None), (None, None, None, None, 1, None, None)]
    assert got(shingle_groups(docs(spark, rows))) == slow_groups([r[:2] for r in rows])
    assert got(shingle_groups(docs(spark, []))) == []
    named = docs(spark, rows).withColumnRenamed("score", "KEY").withColumnRenamed("ids", "node")
    assert got(shingle_groups(named)) == slow_groups([r[:2] for r in rows])


def test_equal_rows_and_a_hot_text(spark):
    df = spark.range(30_000).selectExpr("IF(id < 29000, 7L, id) AS doc_id", "IF(id < 29900, 'one text that very many rows have', 'one text that very many rows have got') AS text")
    rows = [(7, "one text that very many rows have")] * 29_000 + [(k, "one text that very many rows have" + " got" * (k >= 29_900)) for k in range(29_000, 30_000)]
    assert got(shingle_groups(df)) == sorted([(d, len(slow_set(t)), 29_900 if t.endswith("got") else 7) for d, t in rows], key=repr)


def test_op13_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = op13_odd_minhash(spark, sf)
    assert got(df) == slow_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_cells_tie_what_hangs_together():
    rng = np.random.default_rng(4)
    sets = [odd_sketch.shingle_set(t) for _, t in near_copies(rng, 2, 40, 50, 5)]
    cells = {"node": np.arange(80) * 3, "n": np.array([len(s) for s in sets]), "piece": np.zeros(80, int), "asks": np.zeros(80, bool), "sketch": odd_sketch.odd_sketches(odd_sketch.minhashes(sets))}
    links = minhash_dedup.cell_links(cells | {"set": sets}, 85, odd_sketch.most_bits(0.85))
    assert len(links) == len({a for a, _ in links}) and all(b < a for a, b in links)
