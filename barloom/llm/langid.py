"""Operator 2: language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, in segments of SEGMENT bytes at whose ends its state begins
anew, gives label probabilities at every position, and a document's probabilities are the mean over all its positions. It is
trained in numpy by backpropagation through time. Documents are read whole; only training looks at a bounded sample.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import add_columns, clean_name, column, crc_mod, table

UNKNOWN = "und"
#: Bytes in a segment when predicting, and segments that go through the network together.
SEGMENT, BLOCK = 128, 4096
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Sample:
    """Bounds of what training reads: documents of each language and of all, and segments of so many characters from each.

    Of the languages only the most frequent ``langs`` are learned. About one and a half times ``docs``, and 20 more for each
    language, leave the executors.
    """

    docs_per_lang: int = 400
    docs: int = 40_000
    langs: int = 1000
    segments_per_doc: int = 6
    chars: int = 64


class _Direction:
    """One GRU. Arrays hold features in rows and sequences in columns."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.w = (rng.standard_normal((3 * hidden, 256)) * 0.3).astype("f4")
        self.u = (rng.standard_normal((3 * hidden, hidden)) / hidden**0.5).astype("f4")
        self.w[:hidden] += 1.0  # the update gate begins by keeping the state

    def forward(self, x: np.ndarray, active: np.ndarray, tape: list | None = None):
        """Yields (step, state) for the steps given by the rows of x; active: how many of the columns have a byte there."""
        n, h2 = self.h, 2 * self.h
        state = np.zeros((n, x.shape[1]), "f4")
        for t in range(len(x)):
            k = int(active[t])
            old = state[:, :k]
            gates = np.take(self.w, x[t, :k], axis=1, mode="clip")
            rec = self.u @ old
            zr = gates[:h2]
            zr += rec[:h2]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            z, r = zr[:n], zr[n:]
            cand = gates[h2:]
            cand += r * rec[h2:]
            np.tanh(cand, out=cand)
            new = cand + z * (old - cand)
            if tape is not None:
                tape.append((old.copy(), z, r, cand, rec[h2:]))
            state[:, :k] = new
            yield t, state[:, :k]

    def backward(self, x: np.ndarray, tape: list, douts: list[np.ndarray]):
        """Gradients of w and u from those of each step's state (all columns active)."""
        n, dw, du = self.h, np.zeros_like(self.w), np.zeros_like(self.u)
        carry = np.zeros_like(douts[0])
        for t in range(len(x) - 1, -1, -1):
            old, z, r, cand, hid = tape[t]
            d = douts[t] + carry
            dc = d * (1 - z) * (1 - cand * cand)
            dz = d * (old - cand) * z * (1 - z)
            dr = dc * hid * r * (1 - r)
            pre = np.concatenate([dz, dr, dc])
            rec = np.concatenate([dz, dr, dc * r])
            du += rec @ old.T
            carry = d * z + self.u.T @ rec
            onehot = np.zeros((x.shape[1], 256), "f4")
            onehot[np.arange(x.shape[1]), x[t]] = 1
            dw += pre @ onehot
        return dw, du


class ByteBiGRU:
    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.f, self.b = langs, _Direction(hidden, rng), _Direction(hidden, rng)
        self.v = (rng.standard_normal((len(langs), 2 * hidden)) * 0.1).astype("f4")
        self.c = np.zeros((len(langs), 1), "f4")

    def params(self) -> list[np.ndarray]:
        return [self.f.w, self.f.u, self.b.w, self.b.u, self.v, self.c]

    def grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients; x: steps by sequences, y: a label for each sequence."""
        steps, n = x.shape
        full, h = np.full(steps, n), self.f.h
        tf, tb = [], []
        hf = [s.copy() for _, s in self.f.forward(x, full, tf)]
        hb = [s.copy() for _, s in self.b.forward(x[::-1], full, tb)][::-1]
        state = np.concatenate([np.concatenate([a, b]) for a, b in zip(hf, hb)], axis=1)
        logits = self.v @ state + self.c
        logits -= logits.max(axis=0)
        p = np.exp(logits)
        p /= p.sum(axis=0)
        label = np.tile(y, steps)
        at = np.arange(steps * n)
        loss = float(-np.log(p[label, at] + 1e-9).mean())
        p[label, at] -= 1
        p /= steps * n
        dstate = (self.v.T @ p).reshape(2 * h, steps, n)
        df = [dstate[:h, t] for t in range(steps)]
        db = [dstate[h:, t] for t in range(steps)][::-1]
        return loss, [*self.f.backward(x, tf, df), *self.b.backward(x[::-1], tb, db), p @ state.T, p.sum(axis=1, keepdims=True)]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 192, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches; x: one segment of bytes in each row."""
        rng, params = np.random.default_rng(seed), self.params()
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        losses = []
        for k in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grads = self.grads(x[pick].T.astype(np.intp), y[pick])
            losses.append(loss)
            norm = sum(float((g * g).sum()) for g in grads) ** 0.5
            now = rate * min(1.0, k / 20) * (1 - k / (steps + 1)) ** 0.5
            for p, g, a, b in zip(params, grads, m, s):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Sum of the label probabilities over all positions, for each text: texts by languages."""
        k = len(self.langs)
        out = np.zeros((len(texts), k))
        size = np.array([len(t) for t in texts], np.int64)
        count = -(-size // SEGMENT)
        if not count.sum():
            return out
        data = np.frombuffer(b"".join(texts), np.uint8)
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(size) - size, count) + nth * SEGMENT
        length = np.minimum(SEGMENT, size[doc] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")  # so that at each step the columns with a byte come first
        for at in range(0, len(order), BLOCK):
            pick = order[at : at + BLOCK]
            n, most = length[pick], int(length[pick[0]])
            where = start[pick][None, :] + np.arange(most)[:, None]
            x = data[np.minimum(where, len(data) - 1)].astype(np.intp)
            active = (n[None, :] > np.arange(most)[:, None]).sum(axis=1)
            h = self.f.h
            ahead = [s.copy() for _, s in self.f.forward(x, active)]
            total = np.zeros((k, len(pick)), "f4")
            back = np.zeros((h, len(pick)), "f4")
            for t, state in self.b.forward(x[::-1], active[::-1]):
                back = state
                a = ahead[most - 1 - t]
                logits = self.v[:, :h] @ a + self.v[:, h:] @ back + self.c
                np.exp(np.minimum(logits, 60.0, out=logits), out=logits)
                logits /= logits.sum(axis=0)
                total[:, : a.shape[1]] += logits
            np.add.at(out, doc[pick], total.T)
        return out


def training_segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: Sample) -> tuple[list[str], list[str]]:
    """Segments of text and their languages, from at most docs_per_lang documents of each language and docs of all.

    A first pass counts each language; a second keeps the documents whose hash falls below a threshold that the count
    sets, so only about the wanted number of segments ever leave the executors.
    """
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(sample.langs).collect()}
    if not counts:
        return [], []
    per_lang = min(sample.docs_per_lang, -(-sample.docs // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_lang / n + 20 / n))])
    spread = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 30))
    doc = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spread.alias("key")).where(F.col("key") < share[F.col("lang")] * (1 << 30))
    at = F.transform(
        F.sequence(F.lit(0), F.lit(sample.segments_per_doc - 1)),
        lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64(F.col("key"), i), F.greatest(F.char_length("text") - sample.chars, F.lit(1))) + 1).cast("int"), F.lit(sample.chars)),
    )
    rows = doc.select("lang", "key", at.alias("segments")).collect()
    rows.sort(key=lambda r: (r["lang"], r["key"], r["segments"]))
    texts, langs, seen = [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if seen[r["lang"]] < per_lang:
            seen[r["lang"]] += 1
            texts += r["segments"]
            langs += [r["lang"]] * len(r["segments"])
    return texts, langs


def fit_langid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: Sample | None = None, hidden: int = 8, steps: int = 500, seed: int = 7) -> ByteBiGRU:
    """A network trained on the rows of docs that have a language; with no such row, one without languages."""
    sample = sample or Sample()
    texts, langs = training_segments(docs, id_col, text_col, lang_col, sample)
    names = sorted(set(langs))
    net = ByteBiGRU(names, hidden, seed)
    if len(names) > 1:
        size = sample.chars
        raw = [(t * (size // max(1, len(t)) + 1)).encode()[:size] for t in texts]
        keep = [i for i, r in enumerate(raw) if len(r) == size]
        x = np.frombuffer(b"".join(raw[i] for i in keep), np.uint8).reshape(-1, size)
        y = np.array([names.index(langs[i]) for i in keep])
        # Every language is as frequent as the others in a batch.
        rng = np.random.default_rng(seed)
        per = max(np.bincount(y, minlength=len(names)))
        pick = np.concatenate([rng.choice(np.flatnonzero(y == k), per) for k in range(len(names)) if (y == k).any()])
        net.train(x[pick], y[pick], steps)
    return net


def predict_language(df: DataFrame, net: ByteBiGRU, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language of each whole text and the pooled probability of it.

    A null text, or one without a letter, is "und" with score 0; so is every text if the network knows no language. Equal
    probabilities go to the language first by name. Repeated rows give repeated results, an empty table an empty table;
    columns of df named as the new ones are replaced, all others stay.
    """

    def make():
        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            texts = column(b, text_col).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and net.langs and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            sums = net.pooled([texts[i].encode() for i in ok])
            for i, s in zip(ok, sums):
                k = int(s.argmax())
                lang[i], score[i] = net.langs[k], min(1.0, float(s[k] / s.sum()))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return fn

    return add_columns(df, [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())], make)


def fit_on_documents(spark: SparkSession, sf_dir: str) -> ByteBiGRU:
    """The production network: it learns only from documents whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    return fit_langid(docs.where(crc_mod("doc_id", 3) != 1))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = fit_on_documents(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict_language(docs, net).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5, languages: Collection[str] | None = None) -> DataFrame:
    """Pipeline stage: documents of one of ``languages`` (None: of all that the network knows) stay, others go.

    A document goes if it has no language - null texts and those without a letter - or if the predicted one isn't wanted, or
    if no language takes more than ``least`` of its positions' probability: at a half such texts are scraps of a few bytes,
    one word repeated or a mixture. Where lang is null the prediction fills it. Rows stay as they are otherwise, repeated
    ones repeated; columns that happen to be named as those of the prediction are untouched.
    """
    net = fit_on_documents(spark, sf_dir)
    lang, score = clean_name(docs, "lang_pred"), clean_name(docs, "lang_score")
    wanted = (F.col(lang) != UNKNOWN) & (F.col(score) > least)
    if languages is not None:
        wanted &= F.col(lang).isin(sorted(languages))
    kept = predict_language(docs, net, lang_out=lang, score_out=score).where(wanted)
    return kept.select(*[F.coalesce(c, lang).alias(c) if c.lower() == "lang" else c for c in docs.columns])
