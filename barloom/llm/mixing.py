"""Operator 1: mixing sources to target weights by Poisson replication. DataFrame operations only.

Each source has a mean repetition rate: its target share of the mixture over its documents. A document's number of copies
is the inverse of the Poisson distribution with that mean at a uniform number hashed from its id and the seed. Copies are
dealt out by a hash of id, copy and seed, and sorted by it within each partition: a global shuffle that no sampling pass
precedes and that any rerun repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import clean_name, look_up, table, written

SEED, ALPHA = 17, 0.5
#: Means up to this are inverted at once; a larger one is the sum of equal parts, each with a uniform number of its own.
WHOLE = 256.0
#: Sources whose distributions are broadcast, at most.
SOURCES = 1000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Probabilities of at most 0, 1, 2, ... so far that the rest is beyond any hashed number."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(mean) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str | None, float] | None, total: float | None, alpha: float) -> DataFrame:
    """(source, n, rate): documents and mean copies of each source; sources without a weight have rate 0."""
    counts = written(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        pairs = [x for s, w in weights.items() if s is not None for x in (F.lit(s), F.lit(float(w)))]
        known = F.try_element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("double")
        weighed = counts.withColumn("weight", F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(known, F.lit(0.0))))
    sums = weighed.agg(F.sum("weight"), F.sum("n")).first()
    if not sums[0]:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    return weighed.select("source", "n", (F.col("weight") * F.lit(float(sums[1] if total is None else total)) / (F.lit(sums[0]) * F.col("n"))).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float | None = None,
    alpha: float = ALPHA,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy_no",
    order_col: str = "shuffle_key",
) -> DataFrame:
    """docs with each row repeated (or left out) so that sources have their target shares, in shuffled order.

    weights: targets by source, scaled to sum 1; None: in proportion to documents to the power alpha. total: expected rows
    of the mixture (default: rows of docs). copy_col counts a document's copies from 1; order_col is the hash that orders
    them. Null is a source like any other, with the weight under None. Rows with the same id get the same number of
    copies; a null id counts as one id. An empty table, or weights that are all 0, give an empty mixture. Columns of
    docs named as the new ones are replaced; all others, and texts of any length, stay as they are.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (copy_col.lower(), order_col.lower())])
    rates = written(source_rates(docs, source_col, weights, total, alpha), "rates")
    parts = F.greatest(F.ceil(F.col("rate") / WHOLE), F.lit(1)).cast("int")
    src, cdf, chunk, copy, n = (clean_name(docs, x) for x in ("_src", "_cdf", "_parts", copy_col, "_n"))
    # Null is a key of its own.
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rates = rates.where(F.col("rate") > 0).select(named("source").alias(src), F.col("n").alias(n), parts.alias(chunk), poisson_cdf(F.col("rate") / parts).alias(cdf))
    # A row holds a few KB at most, so no more than a thousand sources are broadcast.
    joined = look_up(docs, named(source_col), rates, src, n, F.col(id_col), few=SOURCES, hot=SOURCES).where(F.col(cdf).isNotNull())
    below = lambda j: F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(seed), F.col(id_col), j)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col(chunk)), F.lit(0), lambda acc, j: acc + below(j))
    spread = joined.withColumn(copy, copies).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(cdf, chunk)
    keyed = spread.withColumn(order_col, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy)).cast("binary")))
    return keyed.repartition(order_col).sortWithinPartitions(order_col)


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed so that sources' shares go with the square root of their sizes."""
    return mix_sources(table(spark, sf_dir, "documents"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same mixing over what is left of each source."""
    return mix_sources(docs).select(*docs.columns)


OP1_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, sqrt(n::DOUBLE) * (SELECT sum(n) FROM counts) / ((SELECT sum(sqrt(n::DOUBLE)) FROM counts) * n) AS rate FROM counts
), cdf(source, rate, k, log_p, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)
), tables AS (
  SELECT source, list(total ORDER BY k) AS cdf FROM cdf GROUP BY source
), hashed AS (
  SELECT d.*, t.cdf, ('0x' || substr(md5('17:' || d.doc_id || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, len(list_filter(cdf, lambda c: c <= u)) AS copies FROM hashed
)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, md5('17:' || doc_id || ':' || copy_no) AS shuffle_key
FROM (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy_no FROM counted)
"""
