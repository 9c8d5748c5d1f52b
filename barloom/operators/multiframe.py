"""Several timeframes of one symbol, the divergence reads, and the checklist that weighs all evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.bars import as_of, by_symbol, roll_up, trailing
from barloom.functions import indicators as I
from barloom.operators import kernels as K
from barloom.operators import structure as S

MINUTES = {"1 hour": 60, "4 hours": 240, "1 day": 1440}


def sign_of(direction: Column) -> Column:
    return F.when(direction == "up", 1).when(direction == "down", -1).otherwise(0)


def frame_states(bars: DataFrame, every: str) -> DataFrame:
    """Trend of each closed bar of a larger frame, with the base bar that made it known."""
    htf = roll_up(bars, F.window("ts", every).getField("start"), closed_only=True)
    known = bars.select("symbol", "ts").withColumn("bucket", F.window("ts", every).getField("start")).groupBy("symbol", "bucket").agg(F.min("ts").alias("first"))
    known = known.withColumn("known", F.lead("first").over(Window.partitionBy("symbol").orderBy("bucket"))).where("known IS NOT NULL").select("symbol", F.col("bucket").alias("ts"), "known")
    htf = htf.select("symbol", "ts", "open", "high", "low", "close", "volume")
    t = S.dow_trend(htf, K.swings(I.atr(htf)))
    return t.join(known, ["symbol", "ts"]).select("symbol", F.col("known").alias("ts"), F.struct(sign_of(F.col("direction")).alias("bias"), (F.col("pivots_used") >= 2).alias("ready"), F.lit(MINUTES[every]).alias("minutes")).alias("read"))


def frame_stack(bars: DataFrame, base: str = "1 hour", larger: tuple[str, ...] = ("4 hours", "1 day")) -> DataFrame:
    """Each base bar with its own trend, what the larger frames last closed with, the permitted direction and the alignment.

    The base frame is for timing; the larger ones give the direction.
    """
    own = S.dow_trend(bars, K.swings(I.atr(bars)))
    df = own.select(*bars.columns, "direction", "health", "confidence", "pivots_used", F.struct(sign_of(F.col("direction")).alias("bias"), (F.col("pivots_used") >= 2).alias("ready"), F.lit(MINUTES[base]).alias("minutes")).alias("f0"))
    for k, every in enumerate(larger, 1):
        df = as_of(df, frame_states(bars, every).withColumnRenamed("read", f"f{k}"), ["symbol"], "ts", [f"f{k}"])
    high = F.filter(F.array(*[F.col(f"f{k}") for k in range(1, len(larger) + 1)]), lambda r: r.isNotNull() & r["ready"])
    all_ = F.filter(F.array(*[F.col(f"f{k}") for k in range(len(larger) + 1)]), lambda r: r.isNotNull() & r["ready"])
    biases = F.array_distinct(F.transform(high, lambda r: r["bias"]))
    top = F.get(F.transform(high, lambda r: r["bias"]), F.size(high) - 1)
    opposed = F.exists(high, lambda r: r["bias"] == -top)
    permitted = F.when(F.size(high) == 0, 0).when(F.size(biases) == 1, F.get(biases, F.lit(0))).when((top != 0) & ~opposed, top).otherwise(0)
    total = F.aggregate(all_, F.lit(0.0), lambda a, r: a + r["minutes"] * r["bias"])
    weight = F.aggregate(all_, F.lit(0.0), lambda a, r: a + r["minutes"])
    return df.withColumns({"permitted": permitted, "alignment": F.when(weight <= 0, 0.0).otherwise(total / weight), "n_direction": F.size(high)})


def ma_slope_bias(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """bars with ``ma_bias``: 1 if both averages rise with the fast one on top, -1 if neither does, else 0."""
    w = by_symbol()
    df = I.with_row(bars).withColumns({"_f": I.sma("close", fast), "_s": I.sma("close", slow)})
    df = df.withColumns({"_fu": F.col("_f") > F.lag("_f").over(w), "_su": F.col("_s") > F.lag("_s").over(w), "_st": F.col("_f") > F.col("_s")})
    bias = F.when(F.col("n") < slow, 0).when(F.col("_fu") & F.col("_su") & F.col("_st"), 1).when(~F.col("_fu") & ~F.col("_su") & ~F.col("_st"), -1).otherwise(0)
    return df.withColumns({"ma_bias": bias, "ma_ready": F.col("n") >= slow, "volume_ratio": F.coalesce(F.try_divide("volume", F.avg("volume").over(trailing(30))), F.lit(1.0))}).drop("_f", "_s", "_fu", "_su", "_st")


#: Weight of each checklist item; items without a source here are never answered.
WEIGHTS = (2.5, 1.0, 1.5, 2.5, 1.5, 1.5, 1.5, 1.5, 1.0, 2.0, 1.5, 0.0, 2.0, 1.0, 2.0, 1.5, 1.5, 0.0, 0.0, 1.0, 0.5, 2.0, 1.0)
UNAVAILABLE = (2, 16, 20, 21)


def checklist(df: DataFrame) -> DataFrame:
    """The 23 items of each bar in long form: number, weight, bias, confidence, status.

    df has a row for each bar with: ready, permitted, alignment, n_direction, direction, trend_confidence, pivots_used,
    headroom_up, headroom_down, n_levels, line_bias, n_lines, volume_ratio, retraced, leg_up, gap_bias, and of the live
    patterns of each family reversal_mass and continuation_mass (summed significance), _net (that with the patterns'
    sides) and _n (how many); ma_bias, ma_ready, rsi, rsi_ready, bullish_divergences, bearish_divergences, elliott_bias,
    elliott_confidence, plus_di, minus_di, adx, dmi_ready, candle_bias, has_candle. A null stands for what isn't known.
    """
    zero, one = F.lit(0), F.lit(1.0)
    trend = sign_of(F.col("direction"))
    up, down = F.coalesce("headroom_up", F.lit(float("inf"))), F.coalesce("headroom_down", F.lit(float("inf")))
    leg = F.when(F.col("leg_up"), 1).otherwise(-1)
    r = F.col("retraced")
    vr = F.col("volume_ratio")
    dmi = F.when((F.col("adx") > 20) & (F.abs(F.col("plus_di") - F.col("minus_di")) > 1e-9), F.signum(F.col("plus_di") - F.col("minus_di"))).otherwise(0)

    def mass(kind: str) -> tuple[Column, Column, Column]:
        n = F.coalesce(f"{kind}_n", zero)
        return F.signum(f"{kind}_net"), F.least(F.col(f"{kind}_mass") / F.greatest(n, F.lit(1)), one), n > 0

    items: dict[int, tuple] = {
        1: (F.col("permitted"), F.when(F.col("permitted") != 0, F.least(one, 2 * F.abs("alignment"))).otherwise(0.5), F.col("ready")),
        3: (F.col("permitted"), one, F.col("n_direction") > 0),
        4: (trend, F.col("trend_confidence"), F.col("pivots_used") >= 2),
        5: (F.when(up > down, 1).when(up < down, -1).otherwise(0), one, F.col("n_levels") > 0),
        6: (F.col("line_bias"), one, F.col("n_lines") > 0),
        7: (F.when((vr >= 1.3) & (trend != 0), trend).when((vr < 0.7) & (trend > 0), -1).otherwise(0), one, vr.isNotNull()),
        8: (F.when(r < 0, leg).when(r.between(0.38, 0.62), leg).when(r > 0.66, -leg).otherwise(0), one, r.isNotNull()),
        9: (F.coalesce("gap_bias", zero), one, F.lit(True)),
        10: mass("reversal"),
        11: mass("continuation"),
        12: (zero, one, F.coalesce("reversal_n", zero) + F.coalesce("continuation_n", zero) > 0),
        13: (F.col("ma_bias"), one, F.col("ma_ready")),
        14: (F.when(F.col("rsi") >= 70, -1).when(F.col("rsi") <= 30, 1).otherwise(0), one, F.col("rsi_ready")),
        15: (F.signum(F.coalesce("bullish_divergences", zero) - F.coalesce("bearish_divergences", zero)), one, F.lit(True)),
        17: (F.col("elliott_bias"), F.col("elliott_confidence"), F.col("elliott_bias").isNotNull()),
        18: (zero, one, F.col("elliott_bias").isNotNull()),
        19: (zero, one, F.col("elliott_bias").isNotNull()),
        22: (dmi, F.when(F.col("dmi_ready"), F.least(one, F.col("adx") / 40)).otherwise(0.0), F.col("dmi_ready")),
        23: (F.signum(F.col("candle_bias")), one, F.col("has_candle")),
    }
    out = []
    for n, weight in enumerate(WEIGHTS, 1):
        bias, sure, answered = items.get(n, (zero, one, F.lit(False)))
        status = F.lit("unavailable") if n in UNAVAILABLE else F.when(F.coalesce(answered, F.lit(False)), "answered").otherwise("not_ready")
        out.append(F.struct(F.lit(n).alias("number"), F.lit(weight).alias("weight"), F.coalesce(bias, zero).cast("int").alias("bias"), F.coalesce(sure, zero).cast("double").alias("confidence"), status.alias("status")))
    return df.select("symbol", "ts", F.inline(F.array(*out)))


def verdict(items: DataFrame, state: DataFrame) -> DataFrame:
    """One row for each bar: score, bias, coverage, agreement, conviction and blockers. state: symbol, ts, ready, permitted.

    agreement is the difference of the weights for and against over their sum; without a permitted direction no side is.
    """
    on = F.col("status") == "answered"
    w = F.col("weight") * F.col("confidence")
    g = items.groupBy("symbol", "ts").agg(
        F.sum(F.when(on, F.col("bias") * w).otherwise(0.0)).alias("_s"), F.sum(F.when(on, w).otherwise(0.0)).alias("_w"), (F.count_if(on) / F.count(F.lit(1))).alias("coverage"),
        F.sum(F.when(on & (F.col("bias") > 0), w).otherwise(0.0)).alias("_up"), F.sum(F.when(on & (F.col("bias") < 0), w).otherwise(0.0)).alias("_down"),
    )
    g = g.withColumn("score", F.when(F.col("_w") <= 0, 0.0).otherwise(F.col("_s") / F.col("_w"))).join(state, ["symbol", "ts"])
    bias = F.when(F.col("score") >= 0.12, 1).when(F.col("score") <= -0.12, -1).otherwise(0)
    agree = F.when(F.col("_up") + F.col("_down") <= 0, 0.0).otherwise(F.abs(F.col("_up") - F.col("_down")) / (F.col("_up") + F.col("_down")))
    g = g.withColumns({"bias": bias, "agreement": agree})
    g = g.withColumn("conviction", F.least(F.lit(1.0), F.abs("score") * (0.4 + 0.6 * F.col("coverage")) * (0.5 + 0.5 * F.col("agreement"))))
    blocked = F.array_compact(F.array(F.when(~F.col("ready"), "not ready"), F.when(F.col("coverage") < 0.55, "coverage"), F.when((F.col("bias") != 0) & (F.col("permitted") != F.col("bias")), "higher timeframe")))
    return g.withColumn("blockers", blocked).drop("_s", "_w", "_up", "_down", "ready", "permitted")
