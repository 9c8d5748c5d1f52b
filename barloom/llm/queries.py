"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.elkan import OP12_SQL, op12_elkan_codes
from barloom.llm.fim_sql import OP11_SQL, op11_fill_in_middle
from barloom.llm.langid import op2_language_id
from barloom.llm.minhash_dedup import op13_odd_minhash
from barloom.llm.mixing import OP1_SQL, op1_poisson_mix
from barloom.llm.piece_codec import op4_sentencepiece
from barloom.llm.quality_rank import op6_quality
from barloom.llm.repair import op10_repair_ids
from barloom.llm.repetition import op9_repetition_rules
from barloom.llm.simhash_dedup import op5_simhash_bktree
from barloom.llm.token_counts import op7_token_counts
from barloom.llm.vptree import op3_vptree_search
from barloom.llm.warc import OP8_SQL, op8_warc_index


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_poisson_mix,
            op2_language_id,
            op3_vptree_search,
            op4_sentencepiece,
            op5_simhash_bktree,
            op6_quality,
            op7_token_counts,
            op8_warc_index,
            op9_repetition_rules,
            op10_repair_ids,
            op11_fill_in_middle,
            op12_elkan_codes,
            op13_odd_minhash,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mix": OP1_SQL, "op8_warc_index": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op12_elkan_codes": OP12_SQL}
