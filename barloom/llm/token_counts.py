"""Operator 7: token counts from prefix dynamic programming (see prefix_bpe)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import add_columns, column, table
from barloom.llm.prefix_bpe import load

#: Tokens that a context of the production model holds.
LIMIT = 4096


def count_tokens(df: DataFrame, text_col: str = "text", model: str | None = None, budget: int = LIMIT) -> DataFrame:
    """df with n_tokens (of the whole text, no begin or end) and fit_chars.

    fit_chars is the most characters of the text that encode to at most ``budget`` tokens; it is read off the table of
    exact counts at every prefix, without encoding any prefix again. A null text counts as empty: 0 and 0. Texts of any
    length count whole. Columns of df named n_tokens or fit_chars are replaced, all others stay.
    """

    def make():
        bpe = load(model)

        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in column(b, text_col).to_pylist()]
            counts = [bpe.count(t) for t in texts]
            fits = [len(t) if n <= budget else bpe.cut(t, budget) for t, n in zip(texts, counts)]
            return [pa.array(counts, pa.int64()), pa.array(fits, pa.int64())]

        return fn

    return add_columns(df, [T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())], make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
        "fit_chars",
    )
