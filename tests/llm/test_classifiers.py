"""Operators 2 and 6: gradients, held-out accuracy, odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import regex

from barloom.llm.langid import SEGMENT, UNKNOWN, ByteBiGRU, fit_langid, fit_on_documents, op2_language_id, predict_language, stage_language
from barloom.llm.quality_rank import CUT, FEATURES, fit_bradley_terry, fit_on_labels, fit_quality, op6_quality, score_quality, text_features
from tests.llm.helpers import ROWS, docs, plain


def test_backpropagation_matches_differences():
    net = ByteBiGRU(["a", "b", "c"], hidden=3, seed=1)
    for p in (net.f, net.b):
        p.w, p.u = p.w.astype("f8"), p.u.astype("f8")
    net.v, net.c = net.v.astype("f8"), net.c.astype("f8")
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1])
    _, grads = net.grads(x, y)
    for p, g in zip(net.params(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p.shape[1] == 256:
                at = (at[0], int(x[rng.integers(0, 5), rng.integers(0, 4)]))
            keep, eps = p[at], 1e-3
            p[at] = keep + eps
            up = net.grads(x, y)[0]
            p[at] = keep - eps
            down = net.grads(x, y)[0]
            p[at] = keep
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-4


def test_pooling_does_not_depend_on_the_batch():
    net = ByteBiGRU(["a", "b"], hidden=4, seed=3)
    texts = [b"x" * 5, b"", b"some text " * 60, b"abc"]
    together = net.pooled(texts)
    for k, t in enumerate(texts):
        assert np.allclose(net.pooled([t])[0], together[k], atol=1e-3)
        assert abs(together[k].sum() - len(t)) < 1e-2


@pytest.fixture(scope="module")
def net(spark):
    return fit_langid(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), steps=150)


def test_language_on_odd_rows(spark, net):
    out = predict_language(docs(spark), net)
    assert dict(out.dtypes)["score"] == "double" and out.count() == len(ROWS)
    by_text = {r.text: r for r in out.collect()}
    assert all(by_text[t].lang_pred == UNKNOWN and by_text[t].score == 0 for t in (None, "", " \n\t ", "1234 5678 !!! ###"))
    assert all(r.lang_pred in net.langs and 0 <= r.score <= 1 for t, r in by_text.items() if t and any(map(str.isalpha, t)))
    assert predict_language(docs(spark, []), net).count() == 0


def test_language_without_anything_to_learn_from(spark):
    blind = fit_langid(docs(spark, []))
    assert {r.lang_pred for r in predict_language(docs(spark), blind).collect()} == {UNKNOWN}


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op2_language_id(spark, sf).collect() if r.held_out]
    assert len(rows) > 200 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97


def test_bradley_terry_orders_preferences():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, len(FEATURES)))
    label = (x[:, 0] - 0.5 * x[:, 3] > -0.8).astype(int)
    model = fit_bradley_terry(x, label, pairs=4000)
    s = model.score(x)
    assert ((s >= CUT) == label).mean() > 0.97
    assert s.min() >= 0 and s.max() <= 1
    for only in (0, 1):
        one = fit_bradley_terry(x[:5], np.full(5, only)).score(x[:5])
        assert ((one >= CUT) == only).all()


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = fit_quality(docs(spark), labels)
    out = score_quality(docs(spark), model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and dict(out.dtypes)["score"] == "double"
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= CUT) for r in rows)
    assert text_features(None).tolist() == text_features("").tolist() == [0] * len(FEATURES)
    assert score_quality(docs(spark, []), model).count() == 0
    assert fit_quality(docs(spark), labels.limit(0)).score(np.zeros((1, len(FEATURES)))).shape == (1,)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 40 and np.mean([truth[r.doc_id] == r.predicted for r in rows]) > 0.95
    assert plain(op6_quality(spark, sf), "doc_id", "score") == plain(op6_quality(spark, sf), "doc_id", "score")


# --- both queries against plain loops ---


def slow_language(net, text):
    """One byte after the other, with nothing batched: (language, score)."""
    if not text or not net.langs or not regex.search(r"\p{L}", text):
        return UNKNOWN, 0.0
    data, total = text.encode(), np.zeros(len(net.langs))
    v, c = net.v.astype("f8"), net.c.astype("f8").ravel()

    def states(d, part):
        h, out, n = np.zeros(d.h), [], d.h
        u = d.u.astype("f8")
        for x in part:
            w, r_ = d.w[:, x].astype("f8"), u @ h
            z, r = (1 / (1 + np.exp(-(w[a : a + n] + r_[a : a + n]))) for a in (0, n))
            cand = np.tanh(w[2 * n :] + r * r_[2 * n :])
            h = z * h + (1 - z) * cand
            out.append(h)
        return out

    for a in range(0, len(data), SEGMENT):
        part = data[a : a + SEGMENT]
        for f, b in zip(states(net.f, part), states(net.b, part[::-1])[::-1]):
            p = np.exp(v @ np.concatenate([f, b]) + c)
            total += p / p.sum()
    k = int(total.argmax())
    return net.langs[k], total[k] / len(data)


def slow_features(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * len(FEATURES)
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    n, m = max(1, len(words)), max(1, len(lines))
    share = lambda kind: math.sqrt(len(re.findall(kind, data)) / len(data))
    kinds = [rb"[A-Z]", rb"[0-9]", rb"[.,;:]", rb"[!?]", rb"[|]", rb"[#*$%&<>]", rb"[\"'()\-/=@\[\]\\^_`{}~+]", rb"[ \t\r\v\f]", rb"[\x00-\x08\x0e-\x1f\x7f]"]
    return [math.log(1 + len(words)), math.log(1 + len(data) / n), len(set(words)) / n**0.9, sum(a == b for a, b in zip(words, words[1:])) / n, math.log(1 + n / m), 1 - len(set(lines)) / m, *map(share, kinds)]


def slow_quality(model, text):
    z = [min(8.0, max(-8.0, (x - m) / s)) for x, m, s in zip(slow_features(text), model.mean, model.scale)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, model.weights)) - model.threshold + math.log(CUT / (1 - CUT)))))


def test_op2_equals_a_loop_over_bytes(spark, sf):
    net, texts = fit_on_documents(spark, sf), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        lang, score = slow_language(net, texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == lang and abs(r.score - score) < 2e-3


def test_op6_equals_scalar_features(spark, sf):
    model, texts = fit_on_labels(spark, sf), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert np.allclose(text_features(texts[r.doc_id]), slow_features(texts[r.doc_id]))
        score = slow_quality(model, texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - score) < 1e-9 and (r.predicted == (score >= CUT) or abs(score - CUT) < 1e-9)


def test_learned_weights_are_at_the_least_loss():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((80, len(FEATURES)))
    label = (x[:, 1] + rng.standard_normal(80) > 0).astype(int)
    model = fit_bradley_terry(x, label, pairs=300, seed=3)
    pick = np.random.default_rng(3)
    good, bad = pick.choice(np.flatnonzero(label == 1), 300), pick.choice(np.flatnonzero(label == 0), 300)
    z = np.clip((x - model.mean) / model.scale, -8, 8)

    def loss(w):
        return sum(math.log(1 + math.exp(-sum((z[a, k] - z[b, k]) * w[k] for k in range(len(w))))) for a, b in zip(good, bad)) / 300 + 0.5e-3 * sum(v * v for v in w)

    best = loss(model.weights)
    for k in random.Random(1).sample(range(len(FEATURES)), 5):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert loss(w) > best


def test_rows_that_share_an_id_are_learned_once(spark):
    rows = [(1, f"good text number {k} about nothing", "en", "a", 1, None, None) for k in range(50)] + [(2, "### $$$ |||", "en", "a", 1, None, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    a, b = (fit_quality(docs(spark, r), labels) for r in (rows, rows[::-1]))
    assert np.allclose(a.weights, b.weights) and a.threshold == b.threshold


@pytest.mark.parametrize("name", ["Score", "LANG_PRED", "Predicted", "SCORE"])
def test_clashing_names_in_any_case_are_replaced(spark, net, name):
    rows = docs(spark).drop("score").withColumnRenamed("source", name)
    out = score_quality(predict_language(rows, net), fit_quality(docs(spark), spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")))
    names = [c.lower() for c in out.columns]
    assert len(set(names)) == len(names) and out.select("score", "predicted", "lang_pred").count() == len(ROWS)


def test_language_stage_drops_what_it_does_not_want(spark):
    sf = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 300").limit(60)
    scraps = spark.createDataFrame([(10**9 + k, t, None, "a", 1) for k, t in enumerate([None, "", "123 !!", "  \n"])], clean.schema)
    nameless = clean.limit(5).selectExpr("doc_id + 2000000000 AS doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    got = stage_language(spark, clean.unionByName(scraps).unionByName(nameless), sf).collect()
    assert len(got) == 65 and all(r.lang for r in got)
    assert stage_language(spark, clean, sf, least=1.0).count() == 0
    langs = {r.doc_id: r.lang for r in clean.collect()}
    one = stage_language(spark, clean, sf, languages=["de"]).collect()
    assert {r.doc_id for r in one} == {d for d, lang in langs.items() if lang == "de"}
