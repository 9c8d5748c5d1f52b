"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import written
from barloom.llm.langid import stage_language
from barloom.llm.mixing import stage_mix
from barloom.llm.piece_codec import stage_encode
from barloom.llm.quality_rank import stage_quality
from barloom.llm.simhash_dedup import stage_dedup

STAGES = [
    ("language_id", stage_language),
    ("quality", stage_quality),
    ("near_dedup", stage_dedup),
    ("mix_sources", stage_mix),
    ("encode", stage_encode),
]

#: SQL can't express the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
