"""Operators 1, 8 and 9, and the pipeline."""

import collections
import gzip
import hashlib
import math
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from barloom.llm.langid import fit_on_documents
from barloom.llm.mixing import mix_sources, op1_poisson_mix
from barloom.llm.quality_rank import fit_on_labels
from barloom.llm import repetition as repetition_module
from barloom.llm.repetition import FIELDS, Rules, op9_repetition_rules, repetition, repetition_rules
from barloom.llm.warc import LoserTree, merge_index, op8_warc_index, parse_warc, read_warc, write_warc
from tests.llm.helpers import ROWS, docs, plain
from tests.llm.test_classifiers import slow_language, slow_quality
from tests.llm.test_pairs import slow_fingerprint, slow_groups

# --- repetition ---


def slow_repetition(words, least):
    n = len(words)
    run = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                run[i] = max(run[i], k)
    windows = {i + k for i in range(n) if run[i] >= 5 for k in range(5)}
    runs = {i + k for i in range(n) if run[i] >= least for k in range(run[i])}
    return len(windows), len(runs), max([r for r in run if r >= least], default=0)


def test_suffix_array_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        batch = []
        for _ in range(rng.randint(1, 5)):
            d = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 50))]
            batch.append(d + [b"x"] + d[: rng.randint(0, 30)] if rng.random() < 0.5 else d)
        for least in (3, 5, 8):
            assert [tuple(map(int, x)) for x in zip(*repetition(batch, least))] == [slow_repetition(d, least) for d in batch]


def test_repeats_of_very_long_texts_equal_those_of_short_ones(monkeypatch):
    rng = random.Random(3)
    batch = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 300))] for _ in range(20)] + [[b"x", b"y"] * 500]
    want = repetition(batch, 8)
    monkeypatch.setattr(repetition_module, "KEPT", 10)
    assert all((a == b).all() for a, b in zip(repetition(batch, 8), want))


def slow_rules(text, rules):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, place = len(words), {}
    run = [0] * n
    for i in range(n - 4):  # longest repeats from places that share five words
        place.setdefault(tuple(words[i : i + 5]), []).append(i)
    for same in place.values():
        for i in same:
            for j in same:
                if i != j:
                    k = 5
                    while max(i, j) + k < n and words[i + k] == words[j + k]:
                        k += 1
                    run[i] = max(run[i], k)
    window = len({i + k for i in range(n) if run[i] for k in range(5)})
    covered = len({i + k for i in range(n) if run[i] >= rules.least_words for k in range(run[i])})
    longest = max([r for r in run if r >= rules.least_words], default=0)
    failed = n < 10 or 100 * window > 20 * n
    return n, window, covered, longest, failed, not failed and covered <= rules.covered * n and longest <= rules.longest


def test_op9_over_the_smallest_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_repetition_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.n_repeat_words, r.n_covered_words, r.longest_repeat, r.base_failed, r.kept) == slow_rules(t, Rules())
        assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (len(re.sub(r"[\x20\x09-\x0D]", "", t)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))


def test_clashing_names_in_any_case_are_replaced(spark):
    out = repetition_rules(docs(spark).selectExpr("doc_id", "text", "1 AS Kept", "2 AS N_WORDS"))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.where("kept IS NOT NULL AND n_words >= 0").count() == len(ROWS)


def test_rules_on_odd_rows(spark):
    extra = [(20, "a b c d e f " * 4 + "\n\nline\nline\n x", "en", "a", 1, "x", 1), (21, "one two three four five six seven eight nine ten eleven #|#", "en", "a", 1, None, None)]
    rows = [r for r in ROWS if r[0] != 5] + extra
    got = repetition_rules(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        window, cover, longest = slow_repetition(words, 8)
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.n_dup_lines == len(lines) - len(set(lines))
        assert (r.n_repeat_words, r.n_covered_words, r.longest_repeat) == (window, cover, longest)
        assert r.base_failed == (len(words) < 10 or 100 * window > 20 * len(words))
        assert not (r.base_failed and r.kept)
    long = repetition_rules(docs(spark, [ROWS[4]])).first()
    assert long.n_words == long.n_repeat_words == 120_000 and not long.kept
    assert repetition_rules(docs(spark, [])).columns[-len(FIELDS) :] == [f.name for f in FIELDS]


def test_each_limit_of_repeats_decides_alone(spark):
    w = [f"w{k}" for k in range(500)]
    few = w[:60] + w[:8] + w[60:120] + w[60:68] + w[120:180] + w[120:128]  # three runs of 8, in 48 of 204 words
    texts = {
        "covered": w[:100] + w[:8] + w[100:200] + w[100:108],  # 32 of 216 words, repeats of 8
        "longest": w[:450] + w[:20] + w[450:],  # 40 of 520 words, a repeat of 20
        "passage": w[:300] + w[:30],  # 60 of 330 words, a repeat of 30
        "neither": w[:300] + w[:10],  # 20 of 310 words, a repeat of 10
        "base": few,
    }
    rows = [(k, " ".join(t), "en", "a", 1, None, None) for k, t in enumerate(texts.values())]
    got = dict(zip(texts, sorted(repetition_rules(docs(spark, rows)).collect(), key=lambda r: r.doc_id)))
    assert {k: (r.base_failed, r.kept) for k, r in got.items()} == {"covered": (False, False), "longest": (False, False), "passage": (False, False), "neither": (False, True), "base": (True, False)}
    assert got["covered"].longest_repeat == 8 and got["covered"].n_covered_words > 0.1 * got["covered"].n_words
    assert got["longest"].longest_repeat == 20 and got["longest"].n_covered_words <= 0.1 * got["longest"].n_words


# --- WARC ---


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in range(8):
        runs = [sorted((rng.randint(0, 9), n, r) for n in range(rng.randint(0, 12))) for r in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_on_odd_rows(spark, tmp_path):
    big = "<p>WARC/1.1\r\n\r\nContent-Length: 3</p>é" * 60
    rows = [(1, "http://B.example.com/x?q=1#f", big), (2, "http://a.example.com/", big), (3, None, None), (4, "http://a.example.com/\r\nX: y", ""), (5, "not a url", "short"), (6, "http://a.example.com/", "short"),
            (None, "http://c.example/", big), (7, "http://B.example.com/x?q=1", big + "!"), (7, "http://B.example.com/x?q=1", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/warc"
    write_warc(pages, path)
    got = read_warc(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    want = []
    for i, u, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        rep = max(same) if len(p) >= 1000 and same else None
        revisit = rep is not None and i != rep
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", rep if revisit else None, None if revisit else p))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=repr) == sorted(want, key=repr)
    merged = merge_index(read_warc(spark, path)).orderBy("history_rank").collect()
    assert [r.history_rank for r in merged] == list(range(1, len(rows) + 1))
    keys = [(r.url_key, r.date, r.page_id is not None, r.page_id or 0) for r in merged]
    assert keys == sorted(keys)
    write_warc(pages.limit(0), f"{path}-empty")
    with pytest.raises(ValueError):
        list(parse_warc(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nab"))


def test_records_are_members_at_their_offsets(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, f"http://h{k % 7}.example/p{k}", "".join(rng.choices("abcdefgh<>/ ", k=rng.randint(0, 4000)))) for k in range(300)] + [(900, "http://big.example/", "0123456789abcdef" * (18 << 16)), (901, None, "after")]
    path = f"file://{tmp_path}/warc"
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, file_bytes=50_000)
    got = read_warc(spark, path, payloads=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: h for i, _, h in rows} and len(got) == len(rows)
    files = {r.run for r in got}
    assert len(files) > 5 and all(os.path.getsize(f.removeprefix("file:")) < 60_000 for f in files)
    for r in got:
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            [(_, _, headers, block)] = parse_warc(gzip.decompress(f.read(r.length)))
        assert headers["warc-record-id"] == f"<urn:x-page:{r.page_id}>" and block.endswith(bytes(r.payload))
    merged = merge_index(read_warc(spark, path), range_rows=40).orderBy("history_rank").collect()
    assert [(r.url_key, r.page_id) for r in merged] == sorted((r.url_key, r.page_id) for r in merged) and [r.history_rank for r in merged] == list(range(1, len(rows) + 1))


def test_op8_history_is_in_order(spark, sf):
    rows = op8_warc_index(spark, sf).orderBy("history_rank").collect()
    assert [(r.url_key, r.page_id) for r in rows] == sorted((r.url_key, r.page_id) for r in rows)


# --- mixing ---


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def test_copies_invert_the_poisson_distribution(spark):
    rows = [(i, "t", None, "ab"[i % 2] if i % 5 else None, 1, None, None) for i in range(2000)]
    got = mix_sources(docs(spark, rows), weights={"a": 3.0, None: 1.0, "zzz": 5.0}, total=9000).collect()
    n = {s: sum(r[3] == s for r in rows) for s in ("a", "b", None)}
    rate = {"a": 3 / 4 * 9000 / n["a"], "b": 0.0, None: 1 / 4 * 9000 / n[None]}
    want = {}
    for r in rows:
        u = int(hashlib.md5(f"17:{r[0]}:1".encode()).hexdigest()[:13], 16) / 2**52
        k = poisson(rate[r[3]], u) if rate[r[3]] else 0
        want |= {(r[0], c): 1 for c in range(1, k + 1)}
    assert sorted((r.doc_id, r.copy_no) for r in got) == sorted(want)
    assert abs(len(got) - 9000) < 5 * 9000**0.5
    share = sum(r.source == "a" for r in got) / len(got)
    assert abs(share - 0.75) < 0.03


def test_large_means_are_sums_of_parts(spark):
    got = mix_sources(docs(spark, [(i, "t", None, "a", 1, None, None) for i in range(40)]), total=40 * 700.0).groupBy("doc_id").count().collect()
    counts = [r["count"] for r in got]
    assert len(counts) == 40 and abs(np.mean(counts) - 700) < 5 * (700 / 40) ** 0.5 and 10 < np.std(counts) < 50


def test_mixing_on_odd_rows(spark):
    out = mix_sources(docs(spark), total=60.0)
    assert out.columns == docs(spark).columns + ["copy_no", "shuffle_key"] and out.count() > 0
    assert {r.source for r in out.collect()} <= {"a", "b", "c", None}
    assert mix_sources(docs(spark, [])).count() == 0
    assert mix_sources(docs(spark), weights={"nobody": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs(spark), weights={"a": -1.0})
    clash = docs(spark).selectExpr("*", "1 AS Copy_No", "2 AS _src", "3 AS _cdf")
    assert [c for c in mix_sources(clash).columns if c.lower() in ("copy_no", "_src", "_cdf")] == ["_src", "_cdf", "copy_no"]


def test_mixture_is_shuffled_and_repeatable(spark, sf):
    a, b = op1_poisson_mix(spark, sf).collect(), op1_poisson_mix(spark, sf).collect()
    assert sorted((r.doc_id, r.copy_no) for r in a) == sorted((r.doc_id, r.copy_no) for r in b)
    ids = [r.doc_id for r in a]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.25


# --- pipeline ---


def test_pipeline_equals_plain_loops(spark, sf):
    """Only the two fitted models are the pipeline's own."""
    net, model = fit_on_documents(spark, sf), fit_on_labels(spark, sf)
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    read = [(r, *slow_language(net, r.text)) for r in rows]
    kept = [r for r, lang, score in read if lang != "und" and score > 0.5]
    kept = [r for r in kept if slow_quality(model, r.text) >= 0.3]
    comp = slow_groups([(r.doc_id, slow_fingerprint(r.text)) for r in kept])
    kept = [r for r in kept if comp[r.doc_id] == r.doc_id]
    size = collections.Counter(r.source for r in kept)
    all_ = sum(n**0.5 for n in size.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in kept:
        rate = size[r.source] ** 0.5 / all_ * len(kept) / size[r.source]
        u = int(hashlib.md5(f"17:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
        ids = [1, *lib.encode(r.text), 2]
        want += [(r.doc_id, r.source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] * poisson(rate, u)
    got = plain(corpus_pipeline.run(spark, sf), "doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr) and 0 < len({x[0] for x in got}) < len(rows)


def test_stages_keep_the_columns(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, sf).columns == rows.columns
