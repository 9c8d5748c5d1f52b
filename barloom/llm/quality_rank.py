"""Operator 6: document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Strengths are learned from preference pairs (a document
labelled good is preferred to one labelled bad) with the logistic loss on feature differences. A quantile of the scores
of the labelled documents - the share of bad ones - is the threshold; it maps to a fixed score, so the decision is
score >= CUT.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import add_columns, clean_name, column, crc_mod, table

#: The score of a document whose strength is the threshold.
CUT = 0.3

FEATURES = ("log_words", "word_bytes", "distinct", "stutter", "line_words", "dup_lines", "upper", "digit", "stop_marks", "excited", "bars", "symbols", "other_marks", "space", "control")


def _bytes_of(chars: str) -> np.ndarray:
    hit = np.zeros(256)
    hit[list(chars.encode())] = 1
    return hit


_KINDS = np.stack(
    [
        _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _bytes_of("0123456789"),
        _bytes_of(".,;:"),
        _bytes_of("!?"),
        _bytes_of("|"),
        _bytes_of("#*$%&<>"),
        _bytes_of("\"'()-/=@[]\\^_`{}~+"),
        _bytes_of(" \t\r\v\f"),
        _bytes_of("".join(map(chr, [*range(9), *range(14, 32), 127]))),
    ],
    axis=1,
)


def text_features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; an empty or null one has zeros."""
    data = (text or "").encode()
    out = np.zeros(len(FEATURES))
    if not data:
        return out
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, n_lines = max(1, len(words)), max(1, len(lines))
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS / len(data)
    out[0] = np.log1p(len(words))
    out[1] = len(data) / n
    out[2] = len(set(words)) / n**0.9  # distinct words grow a little slower than words
    out[3] = sum(map(eq, words, words[1:])) / n
    out[4] = np.log1p(n / n_lines)
    out[5] = 1 - len(set(lines)) / n_lines
    out[6:] = np.sqrt(kinds)
    out[1] = np.log1p(out[1])
    return out


@dataclass
class Ranker:
    """Strength of a document: weights times standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def strength(self, features: np.ndarray) -> np.ndarray:
        # Standardised values are bounded: no text is so odd that one feature alone decides without limit.
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return (z * self.weights).sum(axis=-1)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip(self.strength(features) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-x))


def fit_bradley_terry(features: np.ndarray, label: np.ndarray, pairs: int = 20_000, rounds: int = 25, ridge: float = 1e-3, seed: int = 5, bad_share: float | None = None) -> Ranker:
    """Weights from random preference pairs (good over bad), by Newton's method on the ridge-penalised logistic loss.

    bad_share: share of bad documents among all that are labelled, if features holds another share. With labels of only
    one kind there are no pairs, and all documents are equally strong.
    """
    features = np.asarray(features, float).reshape(len(label), len(FEATURES))
    d = features.shape[1]
    if not len(label) or label.min() == label.max():
        good = bool(len(label) and label[0])
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), -2.0 if good or not len(label) else 2.0)
    model = Ranker(features.mean(axis=0), features.std(axis=0) + 1e-3, np.zeros(d))
    z = np.clip((features - model.mean) / model.scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(np.flatnonzero(label == 1), pairs)] - z[rng.choice(np.flatnonzero(label == 0), pairs)]
    w = model.weights
    for _ in range(rounds):
        lost = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # probability that the worse document would win
        grad = -(diff * lost[:, None]).mean(axis=0) + ridge * w
        curve = (diff * (lost * (1 - lost))[:, None]).T @ diff / pairs + ridge * np.eye(d)
        step = np.linalg.solve(curve, grad)
        w = w - step * min(1.0, 2.0 / (np.linalg.norm(step) + 1e-12))
    model.weights = w
    model.threshold = weighted_quantile(model.strength(features), label, bad_share)
    return model


def weighted_quantile(strength: np.ndarray, label: np.ndarray, bad_share: float | None) -> float:
    """The strength under which a share of bad_share of the labelled documents lies, in the middle between its neighbours."""
    bad = float((label == 0).mean()) if bad_share is None else bad_share
    weight = np.where(label == 0, bad / max(1, (label == 0).sum()), (1 - bad) / max(1, (label == 1).sum()))
    order = np.argsort(strength, kind="stable")
    s, below = strength[order], np.cumsum(weight[order])
    k = int(np.searchsorted(below, bad - 1e-9))
    k = min(k, len(s) - 2)
    return float((s[k] + s[k + 1]) / 2)


def with_features(df: DataFrame, text_col: str, out: str) -> DataFrame:
    def make():
        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            texts = column(b, text_col).to_pylist()
            return [pa.array([text_features(t).tolist() for t in texts], pa.list_(pa.float64()))]

        return fn

    return add_columns(df, [T.StructField(out, T.ArrayType(T.DoubleType()))], make)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000) -> Ranker:
    """A ranker from at most about per_class labelled documents of each label (the bound of what training reads).

    The labels are thinned by a hash of the id before they meet the documents, so only a bounded table is broadcast and
    only chosen documents have their features computed.
    """
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if not counts:
        return fit_bradley_terry(np.zeros((0, len(FEATURES))), np.zeros(0, int))
    share = F.when(F.col("label") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    chosen = labels.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30))
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # Rows that share an id count once, so no more rows are read than labels were chosen.
    rows = with_features(both, "text", "features").groupBy("id", "label").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    label = np.array([r["label"] for r in rows], int)
    return fit_bradley_terry(np.array([r["features"] for r in rows]).reshape(len(rows), len(FEATURES)), label, bad_share=counts.get(0, 0) / sum(counts.values()))


def score_quality(df: DataFrame, model: Ranker, text_col: str = "text", score_out: str = "score", predicted_out: str = "predicted") -> DataFrame:
    """df with the score (0 to 1) of each whole text and whether it is at least CUT, as 1 or 0.

    Null and empty texts have the score of all-zero features. Repeated rows give repeated results, an empty table an
    empty table; columns of df named as the new ones are replaced, all others stay.
    """

    def make():
        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            texts = column(b, text_col).to_pylist()
            s = model.score(np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            return [pa.array(s, pa.float64()), pa.array((s >= CUT).astype("i4"), pa.int32())]

        return fn

    return add_columns(df, [T.StructField(score_out, T.DoubleType()), T.StructField(predicted_out, T.IntegerType())], make)


def fit_on_labels(spark: SparkSession, sf_dir: str) -> Ranker:
    """The production ranker: it learns only from labels of rows whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit_quality(docs, labels.where(crc_mod("doc_id", 5) != 0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_on_labels(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score under CUT go.

    Null and empty texts have the score of a text without words, as in score_quality. Rows stay as they are, repeated ones
    repeated; columns that happen to be named as those of the score are untouched.
    """
    model = fit_on_labels(spark, sf_dir)
    score, predicted = clean_name(docs, "quality_score"), clean_name(docs, "quality_predicted")
    return score_quality(docs, model, score_out=score, predicted_out=predicted).where(F.col(predicted) == 1).select(*docs.columns)
