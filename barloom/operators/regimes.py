"""Two volatility states of a return series, by expectation-maximisation.

Short series are fitted a symbol a task. Long ones, which no task should hold, go through rounds that are Spark aggregations: a
round is one aggregation over all symbols: each return's share of the wild state follows from its symbol's parameters, and
sums of 1, x and x squared under both shares give the next ones. Tasks combine their sums before anything is shuffled, so a
symbol's returns may lie anywhere and be any number. Symbols that have converged take no further part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.stats import CALM_SHARE, LEAST_GAIN, LEAST_SAMPLE, MOST_ROUNDS, _FLOOR, fit_two_states
from barloom.session import materialise, ship_package

#: A table of one row for each symbol is broadcast if it has at most so many; a task fits at most so many returns of a symbol by
#: itself; and of those that have more so many rounds are one plan, before their parameters become a table.
FEW, LOCAL, CHAIN = 100_000, 1_000_000, 4
#: The largest ratio of deviations that is reported, and the least risk taken in the wild state.
MOST_RATIO, LEAST_RISK = 50.0, 0.35

_STATE = ("w0", "m0", "v0", "w1", "m1", "v1")


def _log_density(k: int) -> Column:
    w, m, v = (F.col(f"{c}{k}") for c in "wmv")
    away = F.col("x") - m
    return F.ln(F.greatest(w, F.lit(_FLOOR))) - 0.5 * (F.ln(2 * math.pi * v) + away * away / v)


def wild_share() -> Column:
    """The second state's share of x: the logistic of the difference of log densities."""
    d = F.least(F.greatest(_log_density(0) - _log_density(1), F.lit(-700.0)), F.lit(700.0))
    return 1 / (1 + F.exp(d))


def _moments(share: Column, k: int) -> list[Column]:
    x = F.col("x")
    return [F.sum(share).alias(f"s{k}"), F.sum(share * x).alias(f"f{k}"), F.sum(share * x * x).alias(f"g{k}")]


def _state(k: int) -> list[Column]:
    mass = F.greatest(F.col(f"s{k}"), F.lit(_FLOOR))
    mean = F.col(f"f{k}") / mass
    return [(mass / F.col("n")).alias(f"w{k}"), mean.alias(f"m{k}"), F.greatest(F.col(f"g{k}") / mass - mean * mean, F.lit(_FLOOR**2)).alias(f"v{k}")]


def _round(each: DataFrame, key: str) -> DataFrame:
    """The next parameters of each key from its returns beside the present ones; those that are done stay."""
    share, a, b = wild_share(), _log_density(0), _log_density(1)
    like = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    old = ["n", *_STATE, "like", "gain", "rounds", "done"]
    sums = each.groupBy(key).agg(*_moments(1 - share, 0), *_moments(share, 1), F.sum(like).alias("l"), *[F.first(c).alias(c if c == "n" else f"old_{c}") for c in old])
    new = sums.select(
        key, "n", *_state(0), *_state(1), F.col("l").alias("like"), F.abs(F.col("l") - F.col("old_like")).alias("gain"), (F.col("old_rounds") + 1).alias("rounds"), *[f"old_{c}" for c in old[1:]]
    ).withColumn("done", (F.col("gain") < LEAST_GAIN) | (F.col("rounds") >= MOST_ROUNDS))
    return new.select(key, "n", *[F.when(F.col("old_done"), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in old[1:]])


def fit_regimes(returns: DataFrame, key: str, ret: str = "ret", local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """(key, n, w0, m0, v0, w1, m1, v1, converged, rounds), a table with the calmer state first; and the returns it was fitted to.

    Null, non-finite and zero returns aren't data. A fit starts from the returns whose size is within the CALM_SHARE quantile and
    those beyond, and ends when a round's log likelihood changes by less than LEAST_GAIN, or after MOST_ROUNDS. With under
    LEAST_SAMPLE returns there is no fit: both states have mean 0 and the sample's variance, and all is calm. Symbols of at most
    ``local`` returns go through their rounds in a task each, larger ones through rounds that are aggregations.
    """
    ship_package(returns.sparkSession)
    x = F.col(ret).cast("double")
    data = returns.withColumn("x", x).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")) & (F.col("x") != 0))
    data = materialise(data, "barloom/returns")
    counts = materialise(data.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "barloom/counts")
    few = F.broadcast if counts.count() <= FEW else lambda d: d
    pairs = data.select(key, "x")
    kind = data.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = fit_two_states(pdf["x"].to_numpy())
        each = [v for k in (0, 1) for v in (fit["weight"][k], fit["mean"][k], fit["std"][k] ** 2)]
        return pd.DataFrame([(pdf[key].iloc[0], len(pdf), *each, fit["converged"], fit["rounds"])], columns=[key, "n", *_STATE, "converged", "rounds"])

    doubles = ", ".join(f"{c} double" for c in _STATE)
    small = pairs.join(few(counts.where(F.col("n") <= local).select(key)), key, "left_semi")
    fitted = small.groupBy(key).applyInPandas(one, f"`{key}` {kind}, n long, {doubles}, converged boolean, rounds int")
    large = counts.where(F.col("n") > local)
    if not large.isEmpty():
        fitted = fitted.unionByName(_by_rounds(pairs.join(few(large.select(key)), key, "left_semi"), large, key, few))
    return materialise(fitted, "barloom/fit"), data


def _by_rounds(pairs: DataFrame, counts: DataFrame, key: str, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The fit of every key of pairs (key, x), a round for all of them at a time."""
    cuts = materialise(pairs.groupBy(key).agg(F.percentile(F.abs("x"), CALM_SHARE).alias("cut"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("var")).join(counts, key), "barloom/cuts")
    wild = (F.abs("x") > F.col("cut")).cast("double")
    begun = pairs.join(few(cuts), key).groupBy(key).agg(F.first("n").alias("n"), F.first("var").alias("var"), *_moments(1 - wild, 0), *_moments(wild, 1))
    begun = begun.select(key, "n", "var", *_state(0), *_state(1), "s0", "s1")
    fits = F.col("n") >= LEAST_SAMPLE
    # The start's spreads are those of samples; of a state without returns there is none.
    size = lambda k: F.col(f"s{k}") / F.greatest(F.col(f"s{k}") - 1, F.lit(1.0))
    now = begun.select(
        key, "n", "w0", F.when(fits, F.col("m0")).otherwise(0.0).alias("m0"), F.when(fits, F.col("v0") * size(0)).otherwise(F.col("var")).alias("v0"),
        "w1", F.when(fits, F.col("m1")).otherwise(0.0).alias("m1"), F.when(fits, F.col("v1") * size(1)).otherwise(F.col("var")).alias("v1"),
        F.lit(float("-inf")).alias("like"), F.lit(float("inf")).alias("gain"), F.lit(0).alias("rounds"), (~fits).alias("done"),
    )
    now = materialise(now, "barloom/fit")
    while not now.where(~F.col("done")).isEmpty():
        for _ in range(CHAIN):
            now = _round(pairs.join(few(now), key), key)
        now = materialise(now, "barloom/fit")
    swap = F.col("v0") > F.col("v1")
    ordered = [F.when(swap, F.col(f"{c}{1 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}") for k in (0, 1) for c in "wmv"]
    return now.select(key, "n", *ordered, (F.col("gain") < LEAST_GAIN).alias("converged"), "rounds")


def regime_states(returns: DataFrame, key: str, order: str, ret: str = "ret") -> DataFrame:
    """(key, order, state, prob_turbulent, calm_std, turbulent_std, ...): state 1 where the wild one's share is over a half."""
    fit, data = fit_regimes(returns, key, ret)
    few = F.broadcast if fit.count() <= FEW else lambda d: d
    prob = F.when(F.col("n") >= LEAST_SAMPLE, wild_share()).otherwise(0.0)
    both = data.select(key, order, "x").join(few(fit), key).withColumn("prob_turbulent", prob)
    return both.select(
        key, order, (F.col("prob_turbulent") > 0.5).cast("int").alias("state"), "prob_turbulent", F.col("m0").alias("calm_mean"), F.sqrt("v0").alias("calm_std"),
        F.col("m1").alias("turbulent_mean"), F.sqrt("v1").alias("turbulent_std"), "n", "converged", "rounds",
    )


def transitions(states: DataFrame, key: str, order: str, state: str = "state") -> DataFrame:
    """Share of each next state after each state."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = states.withColumn("next", F.lead(state).over(w)).where("next IS NOT NULL").groupBy(key, state, "next").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key, state)))


def regime_risk(states: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key from regime_states: what its last return says, and how much risk to take.

    persistence is the share of the present state's successors that are of the same one (0 without any; 1 without a fit). The
    ratio of deviations is capped, and a fit beyond the cap, or with a state of no deviation, is degenerate. Risk is whole
    in calm and falls with the ratio otherwise.
    """
    last = F.max_by(F.struct("prob_turbulent", "state", "calm_std", "turbulent_std", "n", "converged"), order).alias("l")
    one = states.groupBy(key).agg(last).select(key, "l.*")
    stays = transitions(states, key, order).where("state = next").select(F.col(key).alias("k"), F.col("state").alias("s"), "share")
    one = one.join(stays, (F.col(key) == F.col("k")) & (F.col("state") == F.col("s")), "left")
    calm, wild = F.col("calm_std"), F.col("turbulent_std")
    ratio = F.when(calm <= 0, 1.0).otherwise(F.least(F.lit(MOST_RATIO), wild / calm))
    return one.select(
        key, "prob_turbulent", F.when(F.col("state") == 1, "turbulent").otherwise("calm").alias("label"),
        F.when(F.col("n") < LEAST_SAMPLE, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("persistence"), ratio.alias("vol_ratio"),
        ((calm <= 0) | (wild <= 0) | F.coalesce(F.try_divide(wild, calm) > MOST_RATIO, F.lit(True))).alias("degenerate"),
        F.when(F.col("state") == 0, 1.0).otherwise(F.greatest(F.lit(LEAST_RISK), 1 / F.greatest(F.lit(1.0), ratio))).alias("risk_scalar"), "converged",
    )
