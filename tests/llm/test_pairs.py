"""Operators 3 and 5 against brute force."""

import re

import numpy as np
import pytest
import xxhash

from barloom.llm import simhash_dedup
from barloom.llm.common import look_up
from barloom.llm.components import components
from barloom.llm.simhash import fingerprint
from barloom.llm.simhash_dedup import BKTree, near_links, op5_simhash_bktree, shard_links, simhash_groups, stage_dedup
from barloom.llm.vptree import VPTree, nearest_neighbours, op3_vptree_search, shape, usable
from tests.llm.helpers import ROWS, docs

# --- SimHash ---


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    """doc id -> smallest id reachable, for (id, fingerprint) pairs."""
    up = {d: d for d, _ in prints}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= 4:
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {d: top(d) for d, _ in prints}


def test_fingerprints():
    for t in [r[1] for r in ROWS] + ["One", "a b c", "a b c d", "a b\x0bc\x1cd e\xa0f ÀB g h", "É É É É É"]:
        assert fingerprint(t) == slow_fingerprint(t)
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 40)
    values = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 7))) for b in base for _ in range(8)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    assert len(tree.value) == len(set(values))
    for v in values[::7]:
        assert {tree.value[k] for k in tree.within(v, 4)} == {x for x in values if (x ^ v).bit_count() <= 4}
    assert list(BKTree().within(3, 64)) == []


def test_parts_of_a_shard_link_what_the_whole_does():
    rng = np.random.default_rng(1)
    items = [(sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))), i) for i in range(120)]
    want = slow_groups([(i, fp) for fp, i in items])
    parts = [items[k::3] for k in range(3)]
    links = [x for i in range(3) for j in range(i, 3) for x in shard_links(parts[i], None if i == j else parts[j], 4)]
    up = {i: i for _, i in items}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in links:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    assert {d: top(d) for d in up} == want


@pytest.mark.parametrize("shard", [2048, 4])
def test_links_over_shards_and_split_shards(spark, shard):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    prints = {b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(12)}
    rows = [(fp - (fp >> 63 << 64), i) for i, fp in enumerate(sorted(prints))]
    want = slow_groups([(i, fp) for i, fp in enumerate(sorted(prints))])
    links = near_links(spark.createDataFrame(rows, "fp long, rep long"), shard=shard)
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert {d: got.get(d, d) for d in want} == want


def test_hot_shards_are_split_by_further_bits(spark):
    """Fingerprints that share 30 bits, which further blocks part, and a dense ball, which they don't."""
    rng = np.random.default_rng(4)
    prints = set()
    for _ in range(120):
        fp = int(rng.integers(0, 1 << 34))
        prints |= {fp, fp ^ 1 << int(rng.integers(0, 34)), fp ^ 31 << int(rng.integers(0, 20)), fp ^ 15 << int(rng.integers(0, 30))}
    prints |= {(1 << 63) ^ sum(1 << int(k) for k in rng.integers(40, 64, rng.integers(0, 3))) for _ in range(60)}
    prints = sorted(prints)
    rows = [(fp - (fp >> 63 << 64), i) for i, fp in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    got = {r.node: r.root for r in components(near_links(df, shard=16), "a", "b").collect()}
    want = slow_groups(list(enumerate(prints)))
    assert {d: got.get(d, d) for d in want} == want
    hot = df.selectExpr("1L AS key", f"{-(1 << 34)} AS taken", "fp", "rep").where("fp >= 0")
    below = simhash_dedup.deeper(hot, 4).groupBy("key").count().collect()
    assert max(r["count"] for r in below) < hot.count() / 2


def test_looking_up_hot_keys(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 50}" if k % 2 else None) for k in range(600)], "id long, key string")
    right = left.where("key IS NOT NULL").groupBy("key").count().selectExpr("key AS name", "count AS n", "length(key) AS size")
    want = sorted((r.id, r.key, len(r.key) if r.key else None) for r in left.collect())
    for few in (0, 1000):
        got = look_up(left, left.key, right, "name", "n", left.id, few=few, hot=10)
        assert got.columns == ["id", "key", "size"] and sorted(map(tuple, got.collect())) == want


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(20, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 20 for i in range(21, 61)}, **{k: 100 for k in range(101, 140)}, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_groups_on_odd_rows(spark):
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_groups(docs(spark)).collect()), key=repr)
    prints = [(r[0], fingerprint(r[1])) for r in ROWS]
    comp = slow_groups([p for p in prints if p[0] is not None])
    assert got == sorted(((d, fp, comp.get(d)) for d, fp in prints), key=repr)
    assert comp[6] == 1 and comp[3] == comp[4] == 2
    assert simhash_groups(docs(spark, [])).count() == 0


def test_dedup_stage_keeps_one_of_each_group(spark):
    kept = stage_dedup(spark, docs(spark), None)
    assert kept.columns == docs(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 5, 8, 9, None], key=repr)
    assert stage_dedup(spark, docs(spark, []), None).count() == 0


def test_dedup_with_shared_ids_drops_only_texts_of_which_one_stays(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "the river runs past the old stone mill at night", "copper and tin were traded along this coast for ages"]
    ids = [(5, 0), (5, 1), (5, 1), (3, 1), (7, 0), (5, 2), (2, 2), (9, 3), (2, 3), (None, 0)]
    rows = [(d, texts[k], "en", "a", 1, None, None) for d, k in ids]
    assert all((fingerprint(a) ^ fingerprint(b)).bit_count() > 4 for k, a in enumerate(texts) for b in texts[:k])
    got = sorted(((r.doc_id, r.text) for r in stage_dedup(spark, docs(spark, rows), None).collect()), key=repr)
    assert got == sorted([(5, texts[0]), (3, texts[1]), (2, texts[2]), (2, texts[3]), (None, texts[0])], key=repr)
    groups = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in simhash_groups(docs(spark, rows)).collect()}
    least = {k: min(d for d, j in ids if j == k and d) for k in range(4)}
    assert groups == {(d, fingerprint(texts[k])): least[k] for d, k in ids}


def test_dedup_does_not_depend_on_the_order_of_rows(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "Alpha beta gamma delta epsilon zeta", "ALPHA beta  gamma delta epsilon zeta", "one two three four five six seven eight"]
    rows = [(1, texts[1], "en", "b", 1, None, None), (1, texts[0], "en", "a", 1, None, None), (1, texts[2], "en", "c", 1, None, None), (1, texts[2], "de", "c", 1, None, None), (2, texts[3], None, None, 1, None, None), (2, texts[0], None, None, 1, None, None)]
    for k in range(4):
        order = rows[k:] + rows[:k]
        got = stage_dedup(spark, spark.createDataFrame(order, docs(spark).schema).repartition(1 + k), None).collect()
        assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(1, min(texts[:3]), "de"), (2, texts[3], None)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_dedup_of_very_many_equal_rows(spark, few):
    """A hundred thousand rows of one id and text, and some of many others; no task may hold them all, and one of each stays."""
    df = spark.range(100_300).selectExpr("IF(id < 100000, 5L, id % 100) AS doc_id", "IF(id < 100000, 'one text of very many equal rows', concat('text ', hash(id % 100), ' of ', hash(id % 100 + 7))) AS text", "IF(id % 7 = 0, 'b', 'a') AS lang", "'s' AS source", "map('k', id % 2) AS extra")
    got = stage_dedup(spark, df, None, few=few).collect()
    assert len(got) == 101 and len({(r.doc_id, r.text) for r in got}) == 101
    assert [(r.lang, r.extra) for r in got if r.text.startswith("one")] == [("a", {"k": 0})]


def test_op5_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = slow_groups([(r.doc_id, fingerprint(r.text)) for r in rows])
    got = op5_simhash_bktree(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fingerprint == f"{fingerprint(t.text):016x}" for r, t in zip(sorted(got), sorted(rows)))


def test_block_counts_grow_with_the_table():
    assert simhash_dedup.block_count(10, 4) == 6
    assert simhash_dedup.block_count(10**9, 4) > 6


# --- nearest neighbours ---


def slow_search(vectors, queries, k):
    out = []
    for qi, qv in queries:
        scored = sorted((-float((np.array(qv, float) * np.array(v, float)).sum()), i) for i, v in vectors if i != qi)
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_tree_with_factor_one_is_exact():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 8)) * rng.uniform(0.1, 3, (900, 1))
    v[100:160] = v[100]
    ids = rng.permutation(900)
    tree = VPTree(ids, v, float(np.sqrt((v**2).sum(axis=1).max())), 8)
    q = rng.choice(900, 60)
    r, i, s = tree.search(v[q], ids[q], 7, 1.0)
    want = slow_search(list(zip(ids.tolist(), v)), [(int(ids[x]), v[x]) for x in q], 7)
    got = [(int(ids[q[a]]), int(b)) for a, b in zip(r, i)]
    assert got == [(a, c) for a, _, c, _ in want]


def test_search_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (9, [1.0]), (10, []), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest_neighbours(df, df, k=5).orderBy("query_id", "rank").collect()]
    assert got == slow_search([(1, [1, 2]), (2, [1, 2]), (8, [-1, 0.5])], [(1, [1, 2]), (2, [1, 2]), (8, [-1, 0.5])], 5)
    assert nearest_neighbours(df.limit(0), df, k=5).count() == 0
    assert nearest_neighbours(df, df.limit(0), k=5).count() == 0


@pytest.mark.parametrize("at_once", [30, 1 << 20])
def test_shards_and_blocks_do_not_change_exact_results(spark, at_once):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.standard_normal(6).tolist()) for i in range(300)] + [(300 + i, [1.0] * 6) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df, df.where("vec_id % 3 = 0"), k=4, factor=1.0, shard=50, block=7, at_once=at_once).orderBy("query_id", "rank").collect()]
    assert got == [x[:3] for x in slow_search(rows, [r for r in rows if r[0] % 3 == 0], 4)]


def test_op3_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = slow_search(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = [tuple(r) for r in op3_vptree_search(spark, sf).orderBy("query_id", "rank").collect()]
    hits = {(a, c) for a, _, c, _ in want} & {(a, c) for a, _, c, _ in got}
    assert len(got) == len(want) and len(hits) >= 0.95 * len(want)


def test_norms_of_long_vectors_take_linear_time(spark):
    import time

    df = spark.range(20_000).selectExpr("id AS vec_id", "transform(sequence(1, 256), k -> CAST(hash(id, k) / 2147483648.0 AS float)) AS embedding").persist()
    assert df.count() == 20_000
    for d in (64, 256):
        began = time.perf_counter()
        row = shape(usable(df.selectExpr("vec_id", f"slice(embedding, 1, {d}) AS embedding"), "vec_id", "embedding"))[0]
        assert (row.d, row.n) == (d, 20_000) and 0 < row.unit <= 1 < row.norm < d**0.5
        assert time.perf_counter() - began < 5
    df.unpersist()


def test_many_shards_meet_in_two_steps(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df, df.where("vec_id % 9 = 0"), k=3, factor=1.0, shard=20).orderBy("query_id", "rank").collect()]
    assert got == [x[:3] for x in slow_search(rows, rows[::9], 3)]


def test_search_with_huge_candidates_tiny_queries_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(4) * 1e200).tolist()) for i in range(60)]
    rows += [(60, rows[3][1]), (60, rows[4][1])]
    asked = [(i, (rng.standard_normal(4) * 1e-100).tolist()) for i in range(50, 70)]
    df, q = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, asked))
    one = {i: min(v for j, v in rows if j == i) for i, _ in rows}
    got = [tuple(r) for r in nearest_neighbours(df, q, k=3, factor=1.0, shard=9, block=4).orderBy("query_id", "rank").collect()]
    assert got == slow_search(list(one.items()), asked, 3)
