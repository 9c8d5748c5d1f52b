"""Row-level expressions with guarded divisions and named neutral values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low, high, missing=0.0) -> Column:
    """x within [low, high]; null and NaN give ``missing``."""
    ok = F.least(F.greatest(x, lit(low)), lit(high))
    return F.when(x.isNull() | F.isnan(x), lit(missing)).otherwise(ok)


def ratio(a: Column, b: Column, neutral=0.0, eps: float = EPS) -> Column:
    """a / b, or the neutral value where b is null or nothing."""
    return F.when(b.isNull() | (F.abs(b) <= eps), lit(neutral)).otherwise(a / b)


def squash(x: Column, scale) -> Column:
    """tanh(x / scale); 0 for a scale that isn't positive or an x that isn't finite."""
    s = lit(scale)
    bad = (s <= 0) | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.tanh(x / s))


def linear_map(x: Column, low: float, high: float, out_low: float, out_high: float) -> Column:
    """x from [low, high] to [out_low, out_high], clamped; out_low if the input range has no positive width."""
    if high - low <= EPS:
        return F.lit(float(out_low))
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.lit(float(out_low)) + t * (out_high - out_low)


def typical_price(high="high", low="low", close="close") -> Column:
    return (F.col(high) + F.col(low) + F.col(close)) / 3


def range_pct() -> Column:
    return F.when(F.col("close") <= 0, F.lit(0.0)).otherwise((F.col("high") - F.col("low")) / F.col("close"))


def round_numbers(price: Column, count: int = 3) -> Column:
    """Round price levels around a price: multiples of the power of ten below it and of its half and quarter, ascending."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(price)))
    steps = F.array(power, power / 2, power / 4)
    ks = F.sequence(F.lit(-count), F.lit(count + 1))
    levels = F.flatten(F.transform(steps, lambda s: F.transform(ks, lambda k: F.round((F.floor(price / s) + k) * s, 10))))
    return F.when(price > 0, F.array_sort(F.array_distinct(F.filter(levels, lambda v: v > 0)))).otherwise(F.array().cast("array<double>"))


def nearest_round_number(price: Column) -> Column:
    return F.array_min(F.transform(round_numbers(price), lambda v: F.struct(F.round(F.abs(v - price), 9).alias("d"), v.alias("level"))))["level"]


def offset_stop(stop: Column, is_long: Column, buffer: float = 0.002) -> Column:
    """A stop next to a round number is moved past it by the buffer."""
    level = nearest_round_number(stop)
    near = F.abs(stop - level) <= level * buffer
    return F.when(level.isNull() | ~near, stop).when(is_long, level - level * buffer).otherwise(level + level * buffer)


def retracement_zone(f: Column) -> Column:
    return F.when(f > 2 / 3, "broken").when(f >= 0.618, "maximum").when(f >= 0.40, "entry").when(f >= 1 / 3, "minimum").otherwise("shallow")


def degree(span_bars: Column, bars_per_day: Column) -> Column:
    days = ratio(span_bars.cast("double"), bars_per_day.cast("double"))
    return F.when(days >= 180, "major").when(days >= 21, "intermediate").otherwise("near_term")


def venue_symbol(s: Column) -> Column:
    """BTC/USD -> BTCUSDT; a symbol without a slash only in upper case."""
    base, quote = F.upper(F.split(s, "/")[0]), F.upper(F.split(s, "/")[1])
    return F.when(F.contains(s, F.lit("/")), F.concat(base, F.when(quote == "USD", F.lit("USDT")).otherwise(quote))).otherwise(F.upper(s))


def group_of(s: Column) -> Column:
    """Symbols quoted in dollars form one risk group; any other is its own."""
    return F.when(F.try_element_at(F.split(s, "/"), F.lit(2)).isin("USD", "USDT", "USDC"), F.lit("crypto_usd")).otherwise(s)


def year_month_date(x: Column) -> Column:
    """YYYY.MM as a number (October is .1) -> the month's first day; null outside 1800 to 2200."""
    year = F.floor(x).cast("int")
    month = F.greatest(F.round((x - F.floor(x)) * 100).cast("int"), F.lit(1))
    return F.when(x.isNotNull() & year.between(1800, 2200) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
