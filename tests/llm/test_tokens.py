"""Operators 4, 7 and 10 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import prefix_bpe, repair
from barloom.llm.piece_codec import digests, encode_pieces, op4_sentencepiece
from barloom.llm.token_counts import count_tokens, op7_token_counts
from tests.llm.helpers import ROWS, docs, plain

ALPHABET = "aabcdeeth  \n\t.,éß梦<|>s01▁́🙂"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def random_texts(n, most, seed=1, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_encoding_equals_the_library(lib):
    bpe = prefix_bpe.load()
    texts = random_texts(3000, 40) + [f"a{' ' * n}b" for n in range(60)] + [" " * n for n in range(60)]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode(t), repr(t)
        assert bpe.count(t) == len(lib.encode(t)), repr(t)


def test_prefix_counts_and_cuts_equal_encoding_every_prefix(lib):
    bpe = prefix_bpe.load()
    for t in random_texts(150, 24, seed=2):
        counts = bpe.prefix_counts(t)
        assert counts == [len(lib.encode(t[:i])) for i in range(len(t) + 1)], repr(t)
        for budget in range(0, 16, 3):
            assert bpe.cut(t, budget) == max(i for i, c in enumerate(counts) if c <= budget), repr(t)


def test_memory_generations_keep_results(lib, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "UNITS", 5)
    bpe = prefix_bpe.PrefixBPE(prefix_bpe.default_model())
    for t in random_texts(200, 30, seed=3, alphabet="abcd .,"):
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode(t)


def test_encode_pieces_on_odd_rows(spark, lib):
    out = encode_pieces(docs(spark))
    assert out.count() == len(ROWS) and "score" in out.columns and dict(out.dtypes)["ids"] == "binary"
    got = plain(out.select("doc_id", *digests(out)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in ROWS:
        ids = [1, *lib.encode(r[1] or ""), 2]
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_pieces(docs(spark, [])).count() == 0


def test_count_tokens_on_odd_rows(spark, lib):
    got = plain(count_tokens(docs(spark), budget=5), "doc_id", "n_tokens", "fit_chars")
    want = []
    for r in ROWS:
        t = r[1] or ""
        fit = next(i for i in range(min(len(t), 60), -1, -1) if len(lib.encode(t[:i])) <= 5)
        want.append((r[0], len(lib.encode(t)), fit))
    assert got == sorted(want, key=repr)
    assert count_tokens(docs(spark, [])).count() == 0


def test_queries_over_the_smallest_tables(spark, sf, lib):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_token_counts(spark, sf).collect():
        n = len(lib.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    got = op4_sentencepiece(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = [lib.bos_id(), *lib.encode(texts[r.doc_id]), lib.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_clashing_names_in_any_case_are_replaced(spark):
    rows = docs(spark).selectExpr("doc_id", "text AS Text", "1 AS N_TOKENS", "2 AS IDS", "3 AS Decoded", "4 AS FIT_chars")
    out = count_tokens(encode_pieces(rows))
    assert sorted(c.lower() for c in out.columns) == ["decoded", "doc_id", "fit_chars", "ids", "n_tokens", "text"]
    assert out.select("ids", "n_tokens", "decoded").count() == len(ROWS)


# --- operator 10 ---


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for vocab, hi in ((100, 5), (49408, 40), (1 << 17, 1 << 17)):
        ids = [np.append(rng.integers(0, hi, rng.integers(0, 400)), 2) for _ in range(60)] + [np.array([7] * 1000)]
        block = repair.Block(repair.pack(list(range(60)) + [None], ids, vocab))
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(block.all_ids(), ids))
        for k in rng.integers(0, 61, 10):
            assert (block.ids(int(k)) == ids[k]).all()
        assert block.null[-1] and not block.null[:-1].any()
    assert len(block.left) >= 0


def test_repeats_become_rules():
    ids = [np.array([1, 2, 3, 4] * 500)] * 4
    block = repair.Block(repair.pack([1, 2, 3, 4], ids, 1000))
    assert len(block.left) and len(block.seq) < 8000 / 3
    assert block.length.max() >= 4


def test_units_encode_as_whole_texts_do(words):
    import pyarrow as pa

    tok = repair.load_tokenizer(None)
    texts = random_texts(3000, 30, alphabet="aabTHe's'sÉé́ß  \n\t.,;#|<>!?09Σσ 一—\x85\xa0\x1c²½ªµ") + ["<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>. x", "J\u030c. T\u0308x, W\u030a A\u030a", None, ""]
    got = tok.encode_column(pa.array(texts), 2).to_pylist()
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, tok.kind).tolist() == words.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


def test_token_file_on_odd_rows(spark, words, tmp_path):
    path = f"file://{tmp_path}/tokens"
    repair.write_token_file(docs(spark), path, shard_docs=3)
    got = repair.read_token_file(spark, path).orderBy("start").collect()
    want = sorted(((r[0], np.array(words.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")) for r in ROWS), key=lambda x: (x[0] is not None, x[0]))
    start = 0
    assert [r.doc_id for r in got] == [d for d, _ in want]
    for r, (_, ids) in zip(got, want):
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    repair.write_token_file(docs(spark, []), f"{path}-empty")
    assert repair.read_token_file(spark, f"{path}-empty").count() == 0


def test_op10_over_the_smallest_tables(spark, sf, words):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in repair.op10_repair_ids(spark, sf).collect()}
    start = 0
    for d in sorted(texts):
        ids = np.array(words.encode(texts[d], add_special_tokens=False).ids + [2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def most_occurrences(seq, last):
    """Of the pairs in documents, the most that one occurs without overlaps."""
    count, taken = {}, {}
    for i in range(len(seq) - 1):
        pair = (int(seq[i]), int(seq[i + 1]))
        if not last[i] and taken.get(pair) != i - 1:
            count[pair], taken[pair] = count.get(pair, 0) + 1, i
    return max(count.values(), default=0)


def test_grammar_leaves_no_repeated_pair():
    rng = np.random.default_rng(5)
    for vocab, hi, n in ((4, 4, 3000), (100, 60, 4000), (1 << 16, 3000, 30_000), (1 << 17, 1 << 17, 2000)):
        ids = rng.integers(0, hi, n)
        ids[n // 2 : n // 2 + 700] = ids[:700]  # a passage twice: rules must grow to hundreds of ids
        ids[-50:] = 1
        last = rng.random(n) < 0.001
        last[[699, n // 2 + 699, n - 1]], last[:699], last[n // 2 : n // 2 + 699] = True, False, False
        seq, ends, left, right = repair.compress(ids, last.copy(), vocab)
        assert most_occurrences(seq, ends) < 2
        assert repair.sizes_and_depths(left, right, vocab)[0].max() > 64
        flat, starts, size = repair.expansions(left, right, vocab)
        assert (flat[repair.spread(starts[seq], size[seq])] == ids).all() and ends.sum() == last.sum()
        uses = np.bincount(np.r_[seq, left, right].astype(np.int64), minlength=vocab + len(left))[vocab:]
        assert uses.min() >= 1


def test_smallest_and_largest_ids_come_back(spark, tmp_path):
    rows = [(d, f"text {k}", None, None, None, None, None) for k, d in enumerate([-(1 << 63), None, (1 << 63) - 1, 0, -1])]
    path = f"file://{tmp_path}/tokens"
    repair.write_token_file(docs(spark, rows), path)
    got = repair.read_token_file(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(1 << 63), -1, 0, (1 << 63) - 1]


def test_token_file_deals_many_rows_of_one_id_to_several_shards(spark, words, tmp_path):
    rows = [(7 if k % 2 else None if k % 4 else k, f"text number {k} of them", None, None, None, None, None) for k in range(120)]
    path = f"file://{tmp_path}/tokens"
    repair.write_token_file(docs(spark, rows), path, shard_docs=10)
    blocks = spark.read.parquet(path).collect()
    parts = [repair.Block(bytes(b.data)) for b in sorted(blocks)]
    ids_of = [set(p.doc_id[~p.null].tolist()) for p in parts]
    assert sum(7 in x for x in ids_of) >= 4 and sum(p.null.any() for p in parts) >= 3
    got = repair.read_token_file(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = {np.array(words.encode(r[1], add_special_tokens=False).ids + [2], "<u4").tobytes() for r in rows}
    assert {bytes(r.ids) for r in got} == want and len(got) == len(rows)


def test_marks_after_words_make_no_units_of_their_own(words):
    """A word before marks is met as the word, so the library is asked once for all of its forms."""
    import pyarrow as pa

    tok = repair.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["aveó### aveó*** aveó$$$ aveó%%% aveó&&& aveó. aveó", "x#$ y#|x z<|x q&;x é#̸", "1### #a ##b 'll# l'll#"]
    for t, raw in zip(texts, tok.encode_column(pa.array(texts), 2).to_pylist()):
        assert np.frombuffer(raw, tok.kind).tolist() == words.encode(t, add_special_tokens=False).ids + [2]
    assert [w for w in tok.new if w.startswith("ave")] == ["aveó"]


def test_grammar_of_symbols_too_wide_to_sort_with_their_places():
    rng = np.random.default_rng(3)
    base = 1 << 31
    ids = np.tile(rng.integers(0, base, 300), 20)
    ids[1000:1400] = 9
    last = np.zeros(len(ids), bool)
    last[[599, 2000, len(ids) - 1]] = True
    narrow, wide = repair.compress(ids % 1000, last, 1000), repair.compress(ids, last, base)
    for (seq, ends, left, right), v, k in ((narrow, ids % 1000, 1000), (wide, ids, base)):
        assert most_occurrences(seq, ends) < 2 and len(seq) < 1500
        whole = []
        todo = seq[::-1].tolist()
        while todo:
            x = todo.pop()
            if x < k:
                whole.append(x)
            else:
                todo += [int(right[x - k]), int(left[x - k])]
        assert whole == v.tolist() and ends.sum() == 3


def test_rule_sizes_and_depths_of_chains_and_wide_rounds():
    rng = np.random.default_rng(4)
    for n, reach in ((0, 1), (700, 1), (3000, 2000)):
        left = np.array([100 + max(k - int(rng.integers(1, reach + 1)), -int(rng.integers(1, 99))) for k in range(n)], np.int64)
        right = rng.integers(0, 100, n)
        size, depth = [], []
        for a, b in zip(left - 100, right - 100):
            size.append(sum(size[c] if c >= 0 else 1 for c in (a, b)))
            depth.append(1 + max(depth[c] if c >= 0 else 0 for c in (a, b)))
        got = repair.sizes_and_depths(left, right, 100)
        assert got[0].tolist() == size and got[1].tolist() == depth
