"""Technical indicators as window expressions.

Every function takes bars and returns them with more columns. Rolling windows are counted in rows. Exponential averages
are linear recurrences v = a*v + x and are summed in closed form within blocks of rows, each carried into the next, so
no power leaves the range of a double however long a series is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.bars import by_symbol, so_far, trailing
from barloom.functions.scalars import EPS, clamp, ratio


def with_row(df: DataFrame, name: str = "n") -> DataFrame:
    """Place of each bar in its symbol, from 1."""
    return df if name in df.columns else df.withColumn(name, F.row_number().over(by_symbol()))


def _block(decay: float) -> int:
    """Rows of a block, a power of four: decay ** block is at most 1e-32, so nothing passes over two blocks, and still a double.

    Common periods share a size, and so a sort: all windows of a recurrence are in the order of symbol, block and row.
    """
    size = 16
    while size * -math.log(decay) < 75:
        size *= 4
    return size


def _blocks(df: DataFrame, decay: float) -> tuple[DataFrame, str]:
    """df with its block column (kept for later recurrences) and that column's name."""
    size = _block(decay)
    name = f"_blk{size}"
    df = with_row(df)
    return (df if name in df.columns else df.withColumn(name, F.floor((F.col("n") - 1) / size))), name


def recurrence(df: DataFrame, x: Column, decay: float, out: str) -> DataFrame:
    """out = decay * (out of the row before) + x, from 0; x must not be null."""
    if decay <= 0:
        return df.withColumn(out, x)
    df, b = _blocks(df, decay)
    loc, carry = f"_{out}_loc", f"_{out}_carry"
    j = (F.col("n") - 1) % _block(decay)
    inside = Window.partitionBy("symbol", b).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(loc, F.pow(F.lit(decay), j) * F.sum(x * F.pow(F.lit(decay), -j)).over(inside))
    df = df.withColumn(carry, F.lag(loc).over(Window.partitionBy("symbol").orderBy(b, "n")))
    df = df.withColumn(carry, F.coalesce(F.first(carry).over(inside), F.lit(0.0)))
    return df.withColumn(out, F.col(loc) + F.pow(F.lit(decay), j + 1) * F.col(carry)).drop(loc, carry)


def _seeded(df: DataFrame, x: str, period: int, decay: float, gain: float, out: str, n: str, seed) -> DataFrame:
    """``seed`` over the rows so far up to ``period`` (counted by n, from 1), then out = decay * out + gain * x."""
    df, b = _blocks(df, decay) if decay > 0 else (with_row(df), "n")
    rn, s = F.col(n), f"_{out}_seed"
    order = [b, "n"] if b != "n" else ["n"]
    so_far_ = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(s, seed(F.when(rn >= 1, F.col(x))).over(so_far_))
    x_in = F.when(rn < period, 0.0).when(rn == period, F.col(s)).otherwise(gain * F.col(x))
    df = recurrence(df, F.coalesce(x_in, F.lit(0.0)), decay, out)
    return df.withColumn(out, F.when(rn < period, F.col(s)).otherwise(F.col(out))).drop(s)


def smoothed(df: DataFrame, x: str, period: int, alpha: float, out: str, n: str = "n") -> DataFrame:
    """Running mean for the first ``period`` rows (row number n from 1), then out += alpha * (x - out)."""
    return _seeded(df, x, period, 1 - alpha, alpha, out, n, F.avg)


def ema(df: DataFrame, x: str, period: int, out: str, n: str = "n") -> DataFrame:
    return smoothed(df, x, period, 2 / (period + 1), out, n)


def wilder(df: DataFrame, x: str, period: int, out: str, n: str = "n") -> DataFrame:
    return smoothed(df, x, period, 1 / period, out, n)


def wilder_sum(df: DataFrame, x: str, period: int, out: str, n: str = "n") -> DataFrame:
    """Plain running sum up to ``period`` rows, then out = out - out / period + x."""
    return _seeded(df, x, period, 1 - 1 / period, 1.0, out, n, F.sum)


# --- rolling windows ---


def sma(x: str, p: int) -> Column:
    return F.avg(x).over(trailing(p))


def wma(x: str, p: int) -> Column:
    """Weights 1 to n, n rows being there; needs row number n."""
    w = trailing(p)
    n = F.count(x).over(w)
    weighed = F.sum(F.col(x) * F.col("n")).over(w) - (F.col("n") - n) * F.sum(x).over(w)
    return weighed / (n * (n + 1) / 2)


def momentum(x: str, p: int) -> Column:
    return F.col(x) - F.first(x).over(trailing(p + 1))


def roc(x: str, p: int) -> Column:
    base = F.first(x).over(trailing(p + 1))
    return F.when(F.abs(base) < EPS, F.lit(0.0)).otherwise((F.col(x) - base) / base)


def zscore(x: str, p: int) -> Column:
    w = trailing(p)
    sd = F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    return F.when(sd <= EPS, F.lit(0.0)).otherwise((F.col(x) - F.avg(x).over(w)) / sd)


def percentile_rank(x: str, p: int) -> Column:
    """Share of the window's values that are at most the current one; nulls aren't counted, and 0.5 stands for none."""
    window = F.collect_list(x).over(trailing(p))
    return F.when(F.size(window) == 0, 0.5).otherwise(F.size(F.filter(window, lambda v: v <= F.col(x))) / F.nullif(F.size(window), F.lit(0)))


def stochastic(df: DataFrame, p: int = 14, smooth: int = 3, signal: int = 3) -> DataFrame:
    """Slow %K and %D."""
    w = trailing(p)
    hh, ll = F.max("high").over(w), F.min("low").over(w)
    df = df.withColumn("raw_k", F.when(hh - ll <= EPS, F.lit(50.0)).otherwise(100 * (F.col("close") - ll) / (hh - ll)))
    df = df.withColumn("slow_k", F.avg("raw_k").over(trailing(smooth)))
    return df.withColumn("slow_d", F.avg("slow_k").over(trailing(signal)))


def williams_r(p: int = 14) -> Column:
    w = trailing(p)
    hh, ll = F.max("high").over(w), F.min("low").over(w)
    return F.when(hh - ll <= EPS, F.lit(-50.0)).otherwise(-100 * (hh - F.col("close")) / (hh - ll))


def cci(df: DataFrame, p: int = 20, factor: float = 0.015) -> DataFrame:
    df = df.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("_m", F.avg("tp").over(trailing(p))).withColumn("_l", F.collect_list("tp").over(trailing(p)))
    mad = F.aggregate("_l", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m"))) / F.size("_l")
    return df.withColumn("cci", F.when(mad <= EPS, F.lit(0.0)).otherwise((F.col("tp") - F.col("_m")) / (factor * mad))).drop("_m", "_l")


def bollinger(df: DataFrame, p: int = 20, k: float = 2.0) -> DataFrame:
    """Bands, bandwidth, %B, and the share of the last 5p bandwidths that are at most this one."""
    w = trailing(p)
    mid, sd = F.avg("close").over(w), F.stddev_pop("close").over(w)
    df = df.withColumns({"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd})
    width = F.col("bb_upper") - F.col("bb_lower")
    df = df.withColumns({
        "bb_width": ratio(width, F.col("bb_mid")),
        "percent_b": F.when(width <= EPS, F.lit(0.5)).otherwise((F.col("close") - F.col("bb_lower")) / width),
    })
    return df.withColumn("_w", F.when(F.row_number().over(by_symbol()) >= 2, F.round("bb_width", 12))).withColumn("bb_width_rank", percentile_rank("_w", 5 * p)).drop("_w")


def obv(df: DataFrame) -> DataFrame:
    """On-balance volume, the volume signed by where the close lies in the range, and whether OBV is above its mean of 20."""
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_symbol())), F.lit(0.0)) * F.col("volume")
    span = F.col("high") - F.col("low")
    place = F.when(span <= EPS, F.lit(0.0)).otherwise(2 * (F.col("close") - F.col("low")) / span - 1)
    df = df.withColumns({"_step": step, "_signed": place * F.col("volume")})
    df = df.withColumns({"obv": F.sum("_step").over(so_far()), "signed_volume": F.sum("_signed").over(so_far())}).drop("_step", "_signed")
    ready = F.count("obv").over(trailing(20)) >= 20
    return df.withColumn("obv_rising", F.when(ready, F.col("obv") > F.avg("obv").over(trailing(20))).otherwise(F.col("obv") > 0))


def envelope(df: DataFrame, p: int = 20, pct: float = 0.03) -> DataFrame:
    m = sma("close", p)
    return df.withColumns({"env_mid": m, "env_upper": m * (1 + pct), "env_lower": m * (1 - pct)})


# --- recurrences ---


def true_range(df: DataFrame, out: str = "tr") -> DataFrame:
    before = F.lag("close").over(by_symbol())
    span = F.col("high") - F.col("low")
    return df.withColumn(out, F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before))))


def atr(df: DataFrame, p: int = 14, out: str = "atr") -> DataFrame:
    return wilder(true_range(with_row(df), "_tr"), "_tr", p, out).drop("_tr")


def rsi(df: DataFrame, p: int = 14, out: str = "rsi") -> DataFrame:
    """From the second bar on, Wilder averages of gains and losses; 50 before."""
    df = with_row(df).withColumn("_d", F.col("close") - F.lag("close").over(by_symbol())).withColumn("_n", F.col("n") - 1)
    df = df.withColumns({"_g": F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0)), "_l": F.greatest(-F.coalesce("_d", F.lit(0.0)), F.lit(0.0))})
    df = wilder(wilder(df, "_g", p, "_gain", "_n"), "_l", p, "_loss", "_n")
    flat = F.when(F.col("_gain") > EPS, F.lit(100.0)).otherwise(F.lit(50.0))
    value = F.when(F.col("_n") < 1, F.lit(50.0)).when(F.col("_loss") <= EPS, flat).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return df.withColumn(out, value).drop("_d", "_n", "_g", "_l", "_gain", "_loss")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD, its signal (0 until the slow average is ready) and histogram."""
    df = ema(ema(with_row(df), "close", fast, "_f"), "close", slow, "_s")
    df = df.withColumn("macd", F.col("_f") - F.col("_s")).withColumn("_n", F.col("n") - slow + 1)
    df = ema(df.withColumn("_m", F.when(F.col("_n") >= 1, F.col("macd"))), "_m", signal, "macd_signal", "_n")
    df = df.withColumn("macd_signal", F.when(F.col("_n") >= 1, F.col("macd_signal")).otherwise(0.0))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s", "_m", "_n")


def dmi(df: DataFrame, p: int = 14) -> DataFrame:
    """+DI, -DI, DX and ADX. The first bar gives 0 and doesn't count."""
    w = by_symbol()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = true_range(with_row(df), "_tr").withColumns({"_up": up, "_dn": down}).withColumn("_n", F.col("n") - 1)
    df = df.withColumns({
        "_p": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
        "_m": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
    })
    for c in ("_p", "_m", "_tr"):
        df = wilder_sum(df, c, p, f"_s{c}", "_n")
    live = F.col("_n") >= 1
    df = df.withColumns({
        "plus_di": F.when(live, ratio(100 * F.col("_s_p"), F.col("_s_tr"))).otherwise(0.0),
        "minus_di": F.when(live, ratio(100 * F.col("_s_m"), F.col("_s_tr"))).otherwise(0.0),
    })
    both = F.col("plus_di") + F.col("minus_di")
    df = df.withColumn("dx", F.when(both <= EPS, F.lit(0.0)).otherwise(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both))
    # ADX is DX for p rows, then a running mean of DX from row p on up to row 2p, then a Wilder average.
    n = F.col("_n")
    mean = F.sum(F.when(n >= p, F.col("dx"))).over(so_far()) / (n - p + 1)
    df = df.withColumn("_mean", F.when(n <= p, F.col("dx")).otherwise(mean)).withColumn("_k", n - 2 * p + 1)
    x_in = F.when(F.col("_k") < 1, 0.0).when(F.col("_k") == 1, F.col("_mean")).otherwise(F.col("dx") / p)
    df = recurrence(df, x_in, 1 - 1 / p, "_adx")
    df = df.withColumn("adx", F.when(n < 1, 0.0).when(F.col("_k") < 1, F.col("_mean")).otherwise(F.col("_adx")))
    return df.drop("_tr", "_up", "_dn", "_n", "_p", "_m", "_s_p", "_s_m", "_s_tr", "_mean", "_k", "_adx")


def keltner(df: DataFrame, p: int = 20, atr_p: int = 10, k: float = 2.0) -> DataFrame:
    """Bands around an EMA, and the side of the last close beyond one of them."""
    df = atr(ema(with_row(df), "close", p, "kc_mid"), atr_p, "_a")
    df = df.withColumns({"kc_upper": F.col("kc_mid") + k * F.col("_a"), "kc_lower": F.col("kc_mid") - k * F.col("_a")})
    hit = F.when(F.col("n") < p, None).when(F.col("close") > F.col("kc_upper"), 1).when(F.col("close") < F.col("kc_lower"), -1)
    return df.withColumn("_hit", hit).withColumn("kc_signal", F.coalesce(F.last("_hit", ignorenulls=True).over(so_far()), F.lit(0))).drop("_a", "_hit")


def starc(df: DataFrame, p: int = 6, atr_p: int = 15, k: float = 2.0) -> DataFrame:
    df = atr(with_row(df), atr_p, "_a").withColumn("starc_mid", sma("close", p))
    df = df.withColumns({"starc_upper": F.col("starc_mid") + k * F.col("_a"), "starc_lower": F.col("starc_mid") - k * F.col("_a")})
    return df.withColumns({"starc_risky_buy": F.col("close") >= F.col("starc_upper"), "starc_risky_sell": F.col("close") <= F.col("starc_lower")}).drop("_a")


def feature_snapshot(df: DataFrame, bars_per_year: float, fast: int = 12, slow: int = 26, z: int = 50, donchian: int = 40, vol_rank: int = 200) -> DataFrame:
    """The wide feature row of each bar; ready from row 52 on with the defaults."""
    df = ema(ema(with_row(df), "close", fast, "ema_fast"), "close", slow, "ema_slow")
    df = atr(rsi(df), 14, "atr")
    before = F.lag("ema_slow").over(by_symbol())
    px = F.col("close")
    prev = F.lag("close").over(by_symbol())
    df = df.withColumns({
        "ema_spread": ratio(F.col("ema_fast") - F.col("ema_slow"), px),
        "ema_slope": ratio(F.col("ema_slow") - F.coalesce(before, F.col("ema_slow")), px),
        "roc_fast": roc("close", fast),
        "roc_slow": roc("close", 2 * slow),
        "zscore": zscore("close", z),
        "volume_z": zscore("volume", z),
        "atr_pct": ratio(F.col("atr"), px),
        "ret": F.coalesce(ratio(px - prev, prev), F.lit(0.0)),
        "don_high": F.max("high").over(trailing(donchian)),
        "don_low": F.min("low").over(trailing(donchian)),
    })
    df = df.withColumn("realized_vol", F.coalesce(F.stddev_samp("ret").over(trailing(z)), F.lit(0.0)) * math.sqrt(bars_per_year))
    df = df.withColumn("_v", F.round("realized_vol", 10)).withColumn("vol_percentile", percentile_rank("_v", vol_rank)).drop("_v")
    span = F.col("don_high") - F.col("don_low")
    df = df.withColumn("channel_pos", F.when(span <= EPS, F.lit(0.5)).otherwise(clamp((px - F.col("don_low")) / span, 0.0, 1.0)))
    return df.withColumn("ready", F.col("n") >= max(slow, z, donchian) + 2)
