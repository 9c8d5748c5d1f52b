"""Operator 11: fill-in-middle transformation by DuckDB's SQL inside mapInArrow.

Each Arrow batch is registered with an in-memory DuckDB of the task and one statement cuts its texts into units, draws the
two cuts and the form from the SHA-256 of seed and id, and puts the parts together; another statement rebuilds the texts.
No row is touched by Python. DuckDB runs one thread in a task and writes nothing to disk.
"""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import add_columns, column, table

#: A unit is a run of ASCII letters or any other single character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many put the suffix first.
RATE, SPM = 90, 20
#: Bytes of text that one statement works on, unless a single text has more: a unit takes DuckDB about 16 bytes.
STATEMENT_BYTES = 1 << 20

TRANSFORM = """
WITH cut AS (
  SELECT k, text, regexp_extract_all(text, '{unit}') AS u, sha256('{seed}:' || id) AS h FROM batch
), drawn AS (
  SELECT k, text, u, len(u) AS n,
    ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR ('0x' || h[17:24])::UBIGINT % 100 >= {rate} THEN 'plain'
         WHEN ('0x' || h[25:32])::UBIGINT % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT k, text, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(a, b)::BIGINT), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(a, b)::BIGINT + 1, greatest(a, b)::BIGINT), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(a, b)::BIGINT + 1, n), '') END AS suffix
  FROM drawn
)
SELECT n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN concat('{p}', prefix, '{s}', suffix, '{m}', middle)
            ELSE concat('{s}', suffix, '{p}', prefix, '{m}', middle) END AS fim
FROM parts ORDER BY k
"""

# No part holds a marker, and a marker that follows a part can't start earlier than where the part ends.
RESTORE = """
WITH split AS (
  SELECT k, fim, form, string_split(fim, '{m}') AS halves, string_split(string_split(fim, '{m}')[1], CASE form WHEN 'psm' THEN '{s}' ELSE '{p}' END) AS ends
  FROM batch
)
SELECT CASE form WHEN 'plain' THEN fim
                 WHEN 'psm' THEN concat(substr(ends[1], length('{p}') + 1), halves[2], ends[2])
                 WHEN 'spm' THEN concat(ends[2], halves[2], substr(ends[1], length('{s}') + 1)) END AS restored
FROM split ORDER BY k
"""


def quoted(text: str) -> str:
    return text.replace("'", "''")


def statement(sql: str, seed: str, rate: int, spm: int) -> str:
    return sql.format(unit=quoted(UNIT), p=quoted(PREFIX), s=quoted(SUFFIX), m=quoted(MIDDLE), seed=quoted(seed), rate=rate, spm=spm)


def by_duckdb(df: DataFrame, sql: str, given: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """df with the columns ``fields`` that sql makes, in order of k, of the table ``batch``: k and the columns of ``given``."""

    def make():
        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})

        def fn(b: pa.RecordBatch) -> list[pa.Array]:
            whole = pa.table({"k": pa.array(range(b.num_rows), pa.int64())} | given(b))
            text = whole.column(1).combine_chunks()
            out, at = [], 0
            while at < b.num_rows:
                # As many rows as have STATEMENT_BYTES, one at least.
                rows = max(1, min(b.num_rows - at, b.num_rows * STATEMENT_BYTES // max(1, text.nbytes)))
                while rows > 1 and text.slice(at, rows).nbytes > STATEMENT_BYTES:
                    rows = rows // 2
                con.register("batch", whole.slice(at, rows))
                out.append(con.sql(sql).to_arrow_table())
                con.unregister("batch")
                at += rows
            got = pa.concat_tables(out).cast(pa.schema([(f.name, KINDS[type(f.dataType)]) for f in fields]))
            return [c.combine_chunks() for c in got.columns]

        return fn

    return add_columns(df, fields, make)


KINDS = {T.LongType: pa.int64(), T.StringType: pa.string()}


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = RATE, spm: int = SPM, out: str = "fim") -> DataFrame:
    """df with n (units of the whole text), form, prefix_chars, middle_chars (code points, null if plain) and ``out``.

    The text is cut after the smaller and the larger of two draws of 0 to n units. Form ``plain`` leaves it as it is: empty
    texts, those that hold a marker, and all but ``rate`` of a hundred others; ``spm`` of a hundred of the rest put the
    suffix first (``spm``), the others the prefix (``psm``). Draws depend on seed and id alone, so rows that share an id
    share them and a task that runs again gives the same. A null text counts as empty; a null id draws as an empty one.
    Texts are cut whole whatever their length, in statements of bounded bytes or one text. Repeated rows give repeated
    results, an empty table an empty one. Columns of df named as the new ones, in any case, are replaced.
    """

    def given(b: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"text": column(b, text_col).cast(pa.string()).fill_null(""), "id": column(b, id_col).cast(pa.string()).fill_null("")}

    fields = [T.StructField(n, T.StringType() if n == "form" else T.LongType()) for n in ("n", "form", "prefix_chars", "middle_chars")]
    sql = statement(TRANSFORM, seed, rate, spm).replace("AS fim", f'AS "{out}"')
    return by_duckdb(df, sql, given, [*fields, T.StructField(out, T.StringType())])


def restored_text(df: DataFrame, fim_col: str = "fim", form_col: str = "form", out: str = "restored") -> DataFrame:
    """df with the exact text that ``fim_col`` of form ``form_col`` was made from; null where either is null."""

    def given(b: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fim": column(b, fim_col), "form": column(b, form_col)}

    return by_duckdb(df, statement(RESTORE, "", 0, 0).replace("AS restored", f'AS "{out}"'), given, [T.StructField(out, T.StringType())])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored_text(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("fim").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')) AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS is_plain,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS is_spm FROM docs
), measured AS (
  SELECT *, length(array_to_string(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')[1:least(a, b)], '')) AS p,
    length(array_to_string(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')[1:greatest(a, b)], '')) AS q FROM drawn
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN is_plain THEN 'plain' WHEN is_spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT is_plain THEN p::BIGINT END AS prefix_chars, CASE WHEN NOT is_plain THEN (q - p)::BIGINT END AS middle_chars,
  sha256(CASE WHEN is_plain THEN t
    WHEN is_spm THEN '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM measured
"""
