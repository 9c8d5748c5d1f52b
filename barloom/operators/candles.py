"""Candlestick reading: 37 kinds as expressions over a bar and the two before it.

Sizes are relative to the mean body of the 20 bars before. Each kind is a rule with a condition and a strength; a bar's
signals are the rules that hold, admitted by the trend before it and weighed by volume.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.bars import by_symbol
from barloom.functions import indicators as I

#: Fixed values of the reading.
SMALL, LONG, DOJI, SHADOW, NEGLIGIBLE, LEAST_STRENGTH = 0.5, 1.3, 0.08, 2.0, 0.1, 0.35


class Candle:
    """Anatomy of the bar ``back`` rows before the current one."""

    def __init__(self, back: int):
        get = (lambda c: F.col(f"{c}{back}")) if back else F.col
        self.open, self.high, self.low, self.close = (get(c) for c in ("open", "high", "low", "close"))
        self.top, self.bottom = F.greatest(self.open, self.close), F.least(self.open, self.close)
        self.body, self.range = F.abs(self.close - self.open), self.high - self.low
        self.white, self.black = self.close > self.open, self.close < self.open
        self.mid = (self.open + self.close) / 2
        self.upper, self.lower = self.high - self.top, self.bottom - self.low
        self.frac = F.when(self.range <= 0, 0.0).otherwise(self.body / self.range)
        self.doji = (self.range <= 0) | (self.frac <= DOJI)
        self.small, self.long = self.body <= SMALL * F.col("avg_body"), self.body >= LONG * F.col("avg_body")
        self.bare = (self.upper <= NEGLIGIBLE * self.range) & (self.lower <= NEGLIGIBLE * self.range) & (self.range > 0)


@dataclass
class Rule:
    kind: str
    bias: int
    sessions: int
    holds: Column
    strength: Column
    reversal: bool = True


def within(x: Column, low: float = 0.2, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rules(trend: Column) -> list[Rule]:
    """All kinds; trend is the sign of the trend before the bar."""
    c, p, a = Candle(0), Candle(1), Candle(2)
    out: list[Rule] = []

    def one(kind, bias, holds, strength):
        strength = strength if isinstance(strength, Column) else F.lit(float(strength))
        out.append(Rule(kind, bias, 1, holds, F.when(c.range <= 0, 0.3).otherwise(strength)))

    def more(kind, bias, sessions, holds, strength, reversal=True):
        out.append(Rule(kind, bias, sessions, holds, strength if isinstance(strength, Column) else F.lit(float(strength)), reversal))

    tail_down, tail_up = within(c.lower / c.range), within(c.upper / c.range)
    umbrella = ~c.doji & (c.body > 0) & (c.range > 0) & c.small & (c.lower >= SHADOW * c.body) & (c.upper <= NEGLIGIBLE * c.range)
    inverted = ~c.doji & (c.body > 0) & (c.range > 0) & c.small & (c.upper >= SHADOW * c.body) & (c.lower <= NEGLIGIBLE * c.range)
    one("hammer", 1, umbrella & (trend < 0), tail_down)
    one("hanging_man", -1, umbrella & (trend > 0), tail_down)
    one("shooting_star", -1, inverted & (trend > 0), tail_up)
    one("inverted_hammer", 1, inverted & (trend < 0), tail_up)
    up, down = c.upper / c.range, c.lower / c.range
    dragonfly = c.doji & (c.range > 0) & (up <= NEGLIGIBLE) & (down >= 0.6)
    gravestone = c.doji & (c.range > 0) & (down <= NEGLIGIBLE) & (up >= 0.6)
    legged = c.doji & (c.range > 0) & (up >= 0.3) & (down >= 0.3)
    one("dragonfly_doji", 1, dragonfly, tail_down)
    one("gravestone_doji", -1, gravestone, tail_up)
    one("long_legged_doji", 0, legged, 0.3)
    one("doji", 0, c.doji & ~F.coalesce(dragonfly | gravestone | legged, F.lit(False)), 0.3)
    one("marubozu_white", 1, c.long & c.bare & c.white, within(0.4 + 0.3 * c.body / F.col("avg_body")))
    one("marubozu_black", -1, c.long & c.bare & ~c.white, within(0.4 + 0.3 * c.body / F.col("avg_body")))
    one("belt_hold_bullish", 1, c.long & (c.range > 0) & c.white & (c.lower <= NEGLIGIBLE * c.range), within(c.frac))
    one("belt_hold_bearish", -1, c.long & (c.range > 0) & c.black & (c.upper <= NEGLIGIBLE * c.range), within(c.frac))
    one("spinning_top", 0, ~c.doji & (c.body > 0) & c.small & (c.upper > c.body) & (c.lower > c.body), 0.3)

    bare_pair = p.long & c.long & p.bare & c.bare
    more("kicking_bullish", 1, 2, bare_pair & p.black & c.white & (c.low > p.high), 0.9)
    more("kicking_bearish", -1, 2, bare_pair & p.white & c.black & (c.high < p.low), 0.9)
    more("dark_cloud_cover", -1, 2, p.long & p.white & c.black & (c.open > p.high) & (c.close <= p.mid) & (c.close >= p.bottom), within(0.3 + 0.7 * (p.top - c.close) / p.body))
    more("piercing_line", 1, 2, p.long & p.black & c.white & (c.open < p.low) & (c.close >= p.mid) & (c.close <= p.top), within(0.3 + 0.7 * (c.close - p.bottom) / p.body))

    def engulfs(x: Candle, y: Candle) -> Column:
        return ~y.doji & ~x.doji & (x.top >= y.top) & (x.bottom <= y.bottom) & (x.body > y.body)

    bigger = F.when(p.body <= 0, 0.5).otherwise(within(0.4 + 0.3 * (c.body / p.body - 1)))
    more("engulfing_bullish", 1, 2, engulfs(c, p) & c.white & p.black, bigger)
    more("engulfing_bearish", -1, 2, engulfs(c, p) & c.black & p.white, bigger)
    more("doji_star_bearish", -1, 2, p.long & c.doji & p.white & (c.bottom > p.top), 0.6)
    more("doji_star_bullish", 1, 2, p.long & c.doji & p.black & (c.top < p.bottom), 0.6)

    def harami(y: Candle, x: Candle) -> Column:
        return y.long & (x.top <= y.top) & (x.bottom >= y.bottom) & x.small

    for cross, strength in ((True, 0.65), (False, 0.45)):
        name, is_cross = ("harami_cross", c.doji) if cross else ("harami", ~c.doji)
        more(f"{name}_bullish", 1, 2, harami(p, c) & is_cross & p.black, strength)
        more(f"{name}_bearish", -1, 2, harami(p, c) & is_cross & p.white, strength)
    near = NEGLIGIBLE * F.col("prior_atr")
    bottom = (near > 0) & (F.abs(c.low - p.low) <= near) & (c.low < F.least(p.close, c.close))
    more("tweezer_bottom", 1, 2, bottom, 0.4)
    more("tweezer_top", -1, 2, (near > 0) & ~bottom & (F.abs(c.high - p.high) <= near) & (c.high > F.greatest(p.close, c.close)), 0.4)

    star = p.small & a.long & c.long
    evening = star & a.white & c.black & (p.bottom > a.top) & (c.close <= a.mid)
    morning = star & a.black & c.white & (p.top < a.bottom) & (c.close >= a.mid)
    for kind, bias, holds, depth in (("evening", -1, evening, (a.top - c.close) / a.body), ("morning", 1, morning, (c.close - a.bottom) / a.body)):
        base = 0.55 + 0.35 * within(depth, 0.0, 1.0)
        more(f"{kind}_star", bias, 3, holds & ~p.doji, F.least(base, F.lit(1.0)))
        more(f"{kind}_doji_star", bias, 3, holds & p.doji, F.least(base + 0.05, F.lit(1.0)))
    more("three_outside_up", 1, 3, engulfs(p, a) & p.white & a.black & c.white & (c.close > p.close), 0.8)
    more("three_outside_down", -1, 3, engulfs(p, a) & p.black & a.white & c.black & (c.close < p.close), 0.8)
    more("three_inside_up", 1, 3, harami(a, p) & a.black & c.white & (c.close > a.top), 0.7)
    more("three_inside_down", -1, 3, harami(a, p) & a.white & c.black & (c.close < a.bottom), 0.7)
    stairs = a.long & p.long & c.long & p.open.between(a.bottom, a.top) & c.open.between(p.bottom, p.top)
    more("three_white_soldiers", 1, 3, stairs & a.white & p.white & c.white & (p.close > a.close) & (c.close > p.close), 0.75, False)
    more("three_black_crows", -1, 3, stairs & a.black & p.black & c.black & (p.close < a.close) & (c.close < p.close), 0.75, False)
    return out


def prepared(bars: DataFrame) -> DataFrame:
    """bars with what the rules refer to: sizes over the 20 bars before, the ATR before, and the two bars before."""
    w, prior = by_symbol(), by_symbol().rowsBetween(-20, -1)
    df = I.atr(bars)
    body = F.abs(F.col("close") - F.col("open"))
    df = df.withColumns({
        "avg_body": F.coalesce(F.avg(body).over(prior), F.lit(0.0)),
        "avg_volume": F.coalesce(F.avg("volume").over(prior), F.lit(0.0)),
        "prior_atr": F.coalesce(F.lag("atr").over(w), F.lit(0.0)),
    })
    return df.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in ("open", "high", "low", "close") for k in (1, 2)})


def candle_signals(bars: DataFrame, trend: str = "prior_trend") -> DataFrame:
    """symbol, ts, kind, bias, sessions, strength, volume_ratio: a row for each admitted signal of at least LEAST_STRENGTH."""
    df = prepared(bars).where(F.col("avg_body") > 0)
    t = F.col(trend)
    ratio = F.when(F.col("avg_volume") <= 0, 1.0).otherwise(F.col("volume") / F.col("avg_volume"))
    found = []
    for r in rules(t):
        admitted = F.lit(True) if not r.bias else t == (-r.bias if r.reversal else r.bias)
        weighed = F.when(ratio >= 1.5, F.least(r.strength * 1.15, F.lit(1.0))).when((ratio < 0.7) & F.lit(r.bias > 0), r.strength * 0.85).otherwise(r.strength)
        item = F.struct(F.lit(r.kind).alias("kind"), F.lit(r.bias).alias("bias"), F.lit(r.sessions).alias("sessions"), weighed.alias("strength"))
        found.append(F.when(F.coalesce(r.holds & admitted, F.lit(False)), item))
    hits = F.filter(F.array(*found), lambda s: s.isNotNull() & (s["strength"] >= LEAST_STRENGTH))
    return df.select("symbol", "ts", ratio.alias("volume_ratio"), F.explode(hits).alias("s")).select("symbol", "ts", "s.kind", "s.bias", "s.sessions", "s.strength", "volume_ratio")


def net_bias(bars: DataFrame, signals: DataFrame, back: int = 3) -> DataFrame:
    """symbol, ts, net_bias: the strength-weighted direction of the signals of a bar and the ``back`` before it."""
    per = signals.where("bias <> 0").groupBy("symbol", "ts").agg(F.sum(F.col("strength") * F.col("bias")).alias("_s"), F.sum("strength").alias("_w"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-back, 0)
    df = bars.select("symbol", "ts").join(per, ["symbol", "ts"], "left")
    total, weight = F.coalesce(F.sum("_s").over(w), F.lit(0.0)), F.coalesce(F.sum("_w").over(w), F.lit(0.0))
    return df.select("symbol", "ts", F.when(weight <= 0, 0.0).otherwise(F.greatest(F.least(total / weight, F.lit(1.0)), F.lit(-1.0))).alias("net_bias"))
