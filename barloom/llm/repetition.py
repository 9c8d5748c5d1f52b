"""Operator 9: quality rules with suffix-array repetition.

The words of many documents go through one suffix array, which prefix doubling sorts group by group; suffixes of
different documents never meet, as their first ranks already hold the document. Intervals of longest common prefixes
give the maximal repeated word sequences of each document. The union of their spans is the covered fraction, the deepest
interval the longest repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from barloom.llm.common import add_columns, column, table

BLANKS, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5
#: Words that go through one suffix array, unless a single document has more; beyond so many words ranks of shorter runs aren't kept.
WORDS, KEPT = 400_000, 1 << 21


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict: repeats count from least_words on; then at most so much of the text and so long a repeat.

    A covered share over the base rule's fifth could reject nothing, as covered words lie in repeated windows of five too.
    Of the labelled documents of sf0.1 that pass the base rule (301 bad, 3330 good), over 0.10 are covered in 6 bad and 20
    good ones, the highest odds of the shares tried (0.02 to 0.15); a repeat over 12 words is in 1 bad and 2 good ones.
    """

    least_words: int = 8
    covered: float = 0.10
    longest: int = 12


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, keep: bool = True) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two are equal; only the last without keep.

    symbols: the sequences one after the other, no symbol in two sequences; ends: for each place, where its sequence
    ends. Equal ranks at level k mean equal runs of 2**k symbols. A group's rank is the place of its first member in the
    sorted order, so a place that is alone keeps its rank, and only groups of two and more are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    levels, step = [rank.astype(np.int32)], 1
    active = order[np.repeat(size, size) > 1]
    while len(active):
        after = active + step
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[active] * (n + 1) + second, kind="stable")
        active, second = active[by], second[by]
        old = rank[active]
        first = np.r_[True, old[1:] != old[:-1]]
        new = first | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(first, at, 0))
        part = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + part - group
        if keep:
            levels.append(rank.astype(np.int32))
        size = np.diff(np.r_[np.flatnonzero(new), len(active)])
        active = active[np.repeat(size, size) > 1]
        step *= 2
    return levels if keep else [rank.astype(np.int32)]


def longest_repeat_at(levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """For each place, symbols of the longest repeated run that starts there; 0 if that is under least.

    That is the larger of the common prefixes with both neighbours in the suffix array: the deepest interval around it.
    """
    n = len(ends)
    out = np.zeros(n, np.int64)
    if n < 2 or len(levels) < 2:
        return out
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    low = min(len(levels) - 1, max(0, least.bit_length() - 1))
    same = levels[low][a] == levels[low][b]  # the others share less than least
    a, b = a[same], b[same]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        pa_, pb = a + length, b + length
        ok = (pa_ < ends[a]) & (pb < ends[b])
        ok &= levels[k][np.minimum(pa_, n - 1)] == levels[k][np.minimum(pb, n - 1)]
        length += ok.astype(np.int64) << k
    length[length < least] = 0
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def walked_repeat_at(symbols: np.ndarray, rank: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """What longest_repeat_at gives, from the last ranks alone: place after place, a common prefix is one shorter at least than that of the place before."""
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    out = np.zeros(n, np.int64)
    sym, at, place, end, found = memoryview(np.ascontiguousarray(symbols)), memoryview(rank), memoryview(order), memoryview(np.ascontiguousarray(ends)), memoryview(out)
    shared = 0
    for i in range(n):
        k = at[i]
        if not k:
            shared = 0
            continue
        j = place[k - 1]
        most = min(end[i] - i, end[j] - j)
        while shared < most and sym[i + shared] == sym[j + shared]:
            shared += 1
        if shared >= least:
            found[i] = max(found[i], shared)
            found[j] = max(found[j], shared)
        shared = max(0, shared - 1)
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in at least one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def repetition(docs: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: words in repeated windows of WINDOW words, words in repeated runs of least words and more, words of the longest such run."""
    size = np.array([len(d) for d in docs], np.int64)
    total = int(size.sum())
    if not total:
        return np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    flat = np.empty(total, object)
    flat[:] = [w for d in docs for w in d]
    codes, names = pd.factorize(flat)
    doc = np.repeat(np.arange(len(docs)), size)
    ends = np.repeat(np.cumsum(size), size)
    symbols, kept = doc * np.int64(len(names)) + codes, total <= KEPT
    levels = suffix_ranks(symbols, ends, kept)

    def per_doc(marks: np.ndarray) -> np.ndarray:
        return np.bincount(doc[marks], minlength=len(docs))

    run = longest_repeat_at(levels, ends, min(WINDOW, least)) if kept else walked_repeat_at(symbols, levels[0], ends, min(WINDOW, least))
    window = np.flatnonzero(run >= WINDOW)
    in_window = per_doc(covered(total, window, np.full(len(window), WINDOW)))
    starts = np.flatnonzero(run >= least)
    in_run = per_doc(covered(total, starts, run[starts]))
    longest = np.zeros(len(docs), np.int64)
    np.maximum.at(longest, doc[starts], run[starts])
    return in_window, in_run, longest


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("n_covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def repetition_rules(df: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """df with FIELDS: counts over each whole text and the verdict.

    base_failed: under 10 words, or over a fifth of the words in repeated windows of five. kept: not base_failed, and the
    repeats of rules.least_words words and more cover at most rules.covered of the words and are at most rules.longest
    words long. A null text has no words and so fails, as an empty one does. Texts of any length are read whole; repeated
    rows give repeated results; an empty table gives an empty table. Columns of df named as FIELDS are replaced.
    """

    def make():
        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in column(b, text_col).to_pylist()]
            words = [t.encode().split() for t in texts]
            n_words = np.array([len(w) for w in words], np.int64)
            chars = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
            symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
            dup = []
            for t in texts:
                lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                dup.append(len(lines) - len(set(lines)))
            parts, at = [], 0
            while at < len(words):
                end, held = at, 0
                while end < len(words) and (end == at or held + n_words[end] <= WORDS):
                    held += n_words[end]
                    end += 1
                parts.append(repetition(words[at:end], rules.least_words))
                at = end
            repeat, cover, longest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
            failed = (n_words < 10) | (100 * repeat > 20 * n_words)
            kept = ~failed & (cover <= rules.covered * n_words) & (longest <= rules.longest)
            return [pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dup, repeat, cover, longest)] + [pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]

        return fn

    return add_columns(df, FIELDS, make)


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition_rules(docs).drop("text")
