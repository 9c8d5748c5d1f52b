"""Operator 4: SentencePiece encoding and decoding through a merge-type prefix table (see prefix_bpe)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import add_columns, column, table
from barloom.llm.prefix_bpe import load


def encode_pieces(df: DataFrame, text_col: str = "text", model: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the ids of each whole text, begin and end included, and the text decoded from those ids.

    ids_col is binary: little-endian unsigned 32-bit integers. A null text counts as empty: its ids are begin and end,
    and it decodes to "". Texts of any length are encoded whole; repeated rows give repeated results; an empty table
    gives an empty table. Columns of df named as the new ones are replaced, all others stay.
    """

    def make():
        bpe = load(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (bpe.bos, bpe.eos))

        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            texts = column(b, text_col).to_pylist()
            ids = [begin + bpe.encode(t or "") + end for t in texts]
            return [pa.array(ids, pa.binary()), pa.array((bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids), pa.string())]

        return fn

    return add_columns(df, [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())], make)


def digests(coded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """Token count and digests of what encode_pieces returns, as columns."""
    return [
        (F.octet_length(ids_col) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids_col, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256"),
    ]


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_pieces(docs)
    return coded.select("doc_id", *digests(coded))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: ids of each text with count and digests; a document that was repeated has a row for each copy."""
    coded = encode_pieces(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", *digests(coded))
