"""Performance of equity curves and closed trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import EPS, ratio


def bar_returns(curve: DataFrame, key: str, order: str, equity: str = "equity") -> DataFrame:
    """curve with ``ret`` from point to point; null for the first and after an equity that isn't positive."""
    before = F.lag(equity).over(Window.partitionBy(key).orderBy(order))
    return curve.withColumn("ret", F.when(before > 0, F.col(equity) / before - 1))


def drawdowns(curve: DataFrame, key: str, order: str, equity: str = "equity") -> DataFrame:
    """curve with its peak so far, the fall from it (a share), and the points since the peak."""
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = curve.withColumns({"_i": F.row_number().over(w), "peak": F.max(equity).over(so_far)})
    new_peak = F.col(equity) > F.coalesce(F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf")))
    df = df.withColumn("_at", F.last(F.when(new_peak, F.col("_i")), ignorenulls=True).over(so_far))
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col(equity)) / F.col("peak")).otherwise(0.0)
    return df.withColumns({"drawdown": fall, "bars_down": F.col("_i") - F.col("_at")}).drop("_i", "_at")


def annualise(growth: Column, years: Column) -> Column:
    """growth ** (1 / years) - 1 in logarithms: infinite or -1 where a double can't hold it, 0 for no growth or time."""
    x = F.ln(growth) / years
    return F.when((years <= 0) | (growth <= 0), 0.0).when(x > 709, float("inf")).when(x < -709, -1.0).otherwise(F.exp(x) - 1)


def curve_metrics(curve: DataFrame, key: str, order: str, per_year: float, start: float | None = None, equity: str = "equity") -> DataFrame:
    """One row for each key: returns, volatility, Sharpe, Sortino, worst drawdown and its length, Calmar."""
    df = drawdowns(bar_returns(curve, key, order, equity), key, order, equity)
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by(equity, order).alias("first_equity"),
        F.max_by(equity, order).alias("final_equity"),
        F.avg("ret").alias("_mean"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("_sd"),
        F.coalesce(F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))), F.lit(0.0)).alias("_down"),
        F.count("ret").alias("_n"),
        F.max("drawdown").alias("max_drawdown"),
        # The first of equal worst falls counts.
        F.max_by("bars_down", F.struct("drawdown", (-F.unix_micros(F.col(order).cast("timestamp"))).alias("o"))).alias("max_drawdown_bars"),
    )
    base = F.lit(float(start)) if start else F.col("first_equity")
    root = math.sqrt(per_year)
    g = g.withColumns({
        "total_return": ratio(F.col("final_equity"), base, 1.0) - 1,
        "volatility": F.col("_sd") * root,
        "sharpe": F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root).otherwise(0.0),
        "sortino": F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down") * root).otherwise(0.0),
        "annualised": annualise(F.col("final_equity") / base, F.col("_n") / per_year),
    })
    g = g.withColumn("max_drawdown_bars", F.when(F.col("max_drawdown") > 0, F.col("max_drawdown_bars")).otherwise(0))
    return g.withColumn("calmar", F.when(F.col("max_drawdown") > EPS, F.col("annualised") / F.col("max_drawdown")).otherwise(0.0)).drop("_mean", "_sd", "_down", "_n")


def trade_metrics(trades: DataFrame, key: str, pnl: str = "pnl", risk: str = "risk") -> DataFrame:
    """One row for each key over closed trades; those without a known risk stay out of all R figures."""
    p, known = F.col(pnl), F.col(risk) > EPS
    g = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(p > 0).alias("wins"),
        F.count_if(p <= 0).alias("losses"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("gross_win"),
        F.coalesce(F.abs(F.sum(F.when(p <= 0, p))), F.lit(0.0)).alias("gross_loss"),
        F.avg(p).alias("expectancy"),
        F.max(p).alias("largest_win"),
        F.min(p).alias("largest_loss"),
        F.coalesce(F.avg(F.when(known, p / F.col(risk))), F.lit(0.0)).alias("mean_r"),
        F.coalesce(ratio(F.sum(F.when(known, p)), F.sum(F.when(known, F.col(risk)))), F.lit(0.0)).alias("risk_weighted_r"),
        F.coalesce(F.median(F.when(known, F.col(risk))), F.lit(0.0)).alias("median_risk"),
        F.coalesce(F.min(F.when(known, F.col(risk))), F.lit(0.0)).alias("min_risk"),
        F.coalesce(F.max(F.when(known, F.col(risk))), F.lit(0.0)).alias("max_risk"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("trades_without_risk"),
    )
    return g.withColumns({
        "hit_rate": ratio(F.col("wins"), F.col("trades").cast("double")),
        "profit_factor": F.when(F.col("gross_loss") > EPS, F.col("gross_win") / F.col("gross_loss")).when(F.col("gross_win") > 0, float("inf")).otherwise(0.0),
        "avg_win": ratio(F.col("gross_win"), F.col("wins").cast("double")),
        "avg_loss": ratio(-F.col("gross_loss"), F.col("losses").cast("double")),
        "risk_dispersion": ratio(F.col("max_risk"), F.col("min_risk")),
    })


def edge_stats(outcomes: DataFrame, key: str, order: list[str], r: str = "r", min_sample: int = 30) -> DataFrame:
    """One row for each key: counts, R sums, streaks; a win is an R above 0."""
    w = Window.partitionBy(key).orderBy(*order)
    df = outcomes.withColumn("won", F.col(r) > 0)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "won").orderBy(*order))
    df = df.withColumns({"_island": island, "_i": F.row_number().over(w)})
    runs = df.groupBy(key, "won", "_island").agg(
        F.count(F.lit(1)).alias("n"), F.max("_i").alias("last"), F.sum(r).alias("sum_r")
    )
    g = runs.groupBy(key).agg(
        F.sum("n").alias("count"),
        F.coalesce(F.sum(F.when(F.col("won"), F.col("n"))), F.lit(0)).alias("wins"),
        F.coalesce(F.sum(F.when(~F.col("won"), F.col("n"))), F.lit(0)).alias("losses"),
        F.sum("sum_r").alias("total_r"),
        F.coalesce(F.sum(F.when(F.col("won"), F.col("sum_r"))), F.lit(0.0)).alias("win_r"),
        F.coalesce(F.sum(F.when(~F.col("won"), F.col("sum_r"))), F.lit(0.0)).alias("loss_r"),
        F.coalesce(F.max(F.when(F.col("won"), F.col("n"))), F.lit(0)).alias("longest_win_streak"),
        F.coalesce(F.max(F.when(~F.col("won"), F.col("n"))), F.lit(0)).alias("longest_loss_streak"),
        F.max_by(F.when(F.col("won"), F.col("n")).otherwise(-F.col("n")), "last").alias("current_streak"),
    )
    count = F.col("count").cast("double")
    g = g.withColumns({
        "win_rate": F.col("wins") / count,
        "expectancy_r": F.col("total_r") / count,
        "avg_win_r": ratio(F.col("win_r"), F.col("wins").cast("double")),
        "avg_loss_r": ratio(F.col("loss_r"), F.col("losses").cast("double")),
        "reliable": F.col("count") >= min_sample,
    })
    g = g.withColumn("payoff", ratio(F.col("avg_win_r"), F.abs("avg_loss_r")))
    g = g.withColumn("breakeven", F.when(F.col("payoff") <= 0, 1.0).otherwise(1 / (1 + F.col("payoff"))))
    low, high = wilson(F.col("win_rate"), count)
    return g.withColumns({"edge_margin": F.col("win_rate") - F.col("breakeven"), "wilson_low": low, "wilson_high": high})


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a rate p seen in n trials."""
    z2 = z * z
    below = 1 + z2 / n
    middle, margin = (p + z2 / (2 * n)) / below, z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / below
    return F.greatest(F.lit(0.0), middle - margin), F.least(F.lit(1.0), middle + margin)


def kelly(win_rate: Column, payoff: Column) -> Column:
    """The Kelly share, never below 0."""
    p = F.least(F.greatest(win_rate, F.lit(0.0)), F.lit(1.0))
    return F.when(payoff <= 0, 0.0).otherwise(F.greatest(p - (1 - p) / payoff, F.lit(0.0)))


def kelly_risk(stats: DataFrame, fraction: float = 0.25, cap: float = 0.05) -> DataFrame:
    """stats with the share of equity to risk: a part of Kelly at the lower bound of the win rate, within the cap.

    A sample too small to judge gets the cap.
    """
    full = kelly(F.col("wilson_low"), F.col("payoff"))
    risk = F.when(~F.col("reliable"), cap).when(full <= 0, 0.0).otherwise(F.least(full * fraction, F.lit(cap)))
    binding = F.when(~F.col("reliable"), "sample").when(full <= 0, "no_edge").when(full * fraction < cap, "kelly").otherwise("cap")
    return stats.withColumns({"full_kelly": full, "risk_share": risk, "binding": binding})


def growth_rate(win_rate: Column, payoff: Column, fraction: float) -> Column:
    """Expected log growth of a trade when this share is bet; -infinity where one loss ruins."""
    p = F.least(F.greatest(win_rate, F.lit(0.0)), F.lit(1.0))
    if fraction <= 0:
        return F.lit(0.0)
    if fraction >= 1:
        return F.lit(float("-inf"))
    return p * F.ln(1 + fraction * payoff) + (1 - p) * math.log(1 - fraction)


def streak_probability(length: Column, win_rate: Column, trades: Column) -> Column:
    """Chance of a losing run of at least this length among so many trades, its starts taken as independent."""
    q = 1 - F.least(F.greatest(win_rate, F.lit(0.0)), F.lit(1.0))
    runs = F.greatest(trades - length + 1, F.lit(1))
    return F.when((length <= 0) | (trades <= 0), 1.0).when(q <= 0, 0.0).when(q >= 1, 1.0).otherwise(1 - F.pow(1 - F.pow(q, length), runs))


def expected_worst_streak(win_rate: Column, trades: Column) -> Column:
    q = 1 - F.least(F.greatest(win_rate, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.when(trades <= 0, 0).otherwise(F.greatest(F.floor(F.ln(trades) / F.ln(1 / q)).cast("int"), F.lit(1)))
