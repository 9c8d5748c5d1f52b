"""Trading principles: what keeps and what breaks them, and how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The seven principles, and the one that every violation breaks too.
PRINCIPLES = ("find_edges", "predefine_risk", "accept_risk", "act_without_hesitation", "pay_yourself", "monitor_errors", "never_violate")


def _events(df: DataFrame, keys: list[str], principle: str, outcome: Column) -> DataFrame:
    """Rows with an outcome; a violation also counts against the last principle."""
    both = F.when(F.col("outcome") == "violation", F.array(F.lit(principle), F.lit(PRINCIPLES[-1]))).otherwise(F.array(F.lit(principle)))
    return df.withColumn("outcome", outcome).where("outcome IS NOT NULL").select(*keys, F.explode(both).alias("principle"), "outcome")


def stop_changes(stops: DataFrame, trade: str, order: str) -> DataFrame:
    """Each change of a stop (is_long, stop): moved away from price is a violation, moved closer is kept."""
    before = F.lag("stop").over(Window.partitionBy(trade).orderBy(order))
    df = stops.withColumn("_b", before)
    away = F.when(F.col("is_long"), F.col("stop") < F.col("_b")).otherwise(F.col("stop") > F.col("_b"))
    return _events(df, [trade, order], "accept_risk", F.when(F.col("_b").isNull(), None).when(away, "violation").when(F.col("stop") != F.col("_b"), "kept"))


def entries(df: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (stop, planned_risk, equity): without a stop is a violation, over 5% of equity at risk a warning."""
    missing = F.col("stop").isNull() | (F.col("stop") <= 0)
    return _events(df, keys, "predefine_risk", F.when(missing, "violation").when(F.col("planned_risk") > 0.05 * F.col("equity"), "warning").otherwise("kept"))


def signals_acted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Signals (valid, acted): a valid one that was let pass is a violation."""
    return _events(df, keys, "act_without_hesitation", F.when(F.col("valid"), F.when(F.col("acted"), "kept").otherwise("violation")))


def profits_given_back(df: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Closed trades (best_r, final_r): half of at least 2R given back is a warning."""
    gave = (F.col("best_r") - F.col("final_r")) / F.nullif(F.col("best_r"), F.lit(0.0))
    return _events(df, keys, "pay_yourself", F.when(F.col("best_r") >= 2, F.when(gave >= share, "warning").otherwise("kept")))


def interventions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides by hand are violations."""
    return _events(df, keys, "monitor_errors", F.when(F.col("by_hand"), "violation"))


def adherence(events: DataFrame, principle: str = "principle", severity: str = "severity") -> DataFrame:
    """Counts of each principle and the share that kept it; 1 without events."""
    s = F.col(severity)
    return events.groupBy(principle).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(s == "violation").alias("violations"), F.count_if(s == "warning").alias("warnings"), F.coalesce(F.count_if(s == "kept") / F.count(F.lit(1)), F.lit(1.0)).alias("kept_rate")
    )
