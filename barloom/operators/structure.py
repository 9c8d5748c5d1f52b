"""Market structure over confirmed pivots, as windows and joins.

A pivot may be used only from the bar that confirmed it, so all joins to bars go by confirmed_index.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.bars import by_symbol, numbered, so_far, trailing
from barloom.functions.scalars import EPS
from barloom.operators.kernels import gap_fates, scan_stacked

FLAT = 0.0025


def legs(pivots: DataFrame) -> DataFrame:
    """Each pivot with the leg that ends in it."""
    w = Window.partitionBy("symbol").orderBy("confirmed_index")
    df = pivots.withColumns({"start_price": F.lag("price").over(w), "start_index": F.lag("index").over(w)}).where("start_price IS NOT NULL")
    change = F.col("price") - F.col("start_price")
    return df.withColumns({
        "is_up": change > 0, "height": F.abs(change), "bars": F.col("index") - F.col("start_index"), "pct": F.when(F.col("start_price") <= 0, 0.0).otherwise(change / F.col("start_price")),
    })


def _compared(before: Column, now: Column) -> Column:
    """1 rising, -1 falling, 0 level."""
    change = (now - before) / before
    return F.when((before <= 0) | (F.abs(change) <= FLAT), 0).otherwise(F.signum(change).cast("int"))


def dow_trend(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each bar with the trend that its last two known peaks and troughs make, its health and confidence."""
    kind = Window.partitionBy("symbol", "kind").orderBy("confirmed_index")
    p = pivots.withColumns({
        "before": F.lag("price").over(kind), "used": F.row_number().over(Window.partitionBy("symbol").orderBy("confirmed_index")),
    }).select("symbol", F.col("confirmed_index").alias("i"), "kind", "price", "before", "used", F.col("index").alias("p_index"))
    df = numbered(bars).join(p, ["symbol", "i"], "left")
    last = lambda c: F.last(c, ignorenulls=True).over(so_far())
    two = {}
    for k in ("peak", "trough"):
        here = (F.col("kind") == k) & F.col("before").isNotNull()
        two[f"{k}_before"], two[f"{k}_last"] = last(F.when(here, F.col("before"))), last(F.when(here, F.col("price")))
    df = df.withColumns({**two, "pivots_used": F.coalesce(last("used"), F.lit(0))})
    peaks, troughs = _compared(F.col("peak_before"), F.col("peak_last")), _compared(F.col("trough_before"), F.col("trough_last"))
    known = F.col("peak_before").isNotNull() & F.col("trough_before").isNotNull()
    df = df.withColumn("direction", F.when(~known, "unknown").when((peaks > 0) & (troughs > 0), "up").when((peaks < 0) & (troughs < 0), "down").otherwise("sideways"))
    way, px = F.col("direction"), F.col("close")
    broken = ((way == "up") & (px < F.col("trough_last"))) | ((way == "down") & (px > F.col("peak_last"))) | ((way == "sideways") & ((px > F.col("peak_last")) | (px < F.col("trough_last"))))
    df = df.withColumn("health", F.when(F.coalesce(broken, F.lit(False)), "support_broken").otherwise("intact"))
    base = F.when(F.col("health") == "intact", 1.0).otherwise(0.2) * F.when(way == "sideways", 0.5).otherwise(1.0)
    sure = F.when(way == "unknown", 0.0).otherwise(base * (0.5 + 0.5 * F.least(F.lit(1.0), F.least(F.col("pivots_used"), F.lit(200)) / 4)))
    return df.withColumn("confidence", sure).drop("kind", "price", "before", "used", "p_index")


def retracements(pivots: DataFrame) -> DataFrame:
    """Retracement and projection prices of the leg that ends in each pivot."""
    df = legs(pivots)
    change, end = F.col("price") - F.col("start_price"), F.col("price")
    back = {"r33": 1 / 3, "r38": 0.382, "r50": 0.5, "r62": 0.618, "r67": 2 / 3}
    ahead = {"fib_1000": 1.0, "fib_1382": 1.382, "fib_1618": 1.618, "fib_2618": 2.618}
    return df.withColumns({k: end - change * v for k, v in back.items()} | {k: end + change * v for k, v in ahead.items()})


def signed_retracement(start: Column, end: Column, price: Column) -> Column:
    """Share of a leg that price has taken back: under 0 beyond its end, over 1 beyond its start."""
    return F.when(F.abs(end - start) <= EPS, 0.0).otherwise((end - price) / (end - start))


def speed_line(origin: Column, origin_at: Column, extreme: Column, extreme_at: Column, at: Column, part: float) -> Column:
    """The line from the origin through this part of the move, at a bar."""
    run = extreme_at - origin_at
    return F.when(run <= 0, origin).otherwise(origin + (extreme - origin) * part / run * (at - origin_at))


def flagged_gaps(bars: DataFrame, atr: str = "atr", least: float = 0.25) -> DataFrame:
    """bars with is_gap, up, gap_low, gap_high and volume_ratio: whether each left a gap to the one before."""
    w = by_symbol()
    b = numbered(bars).withColumns({
        "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "mean_volume": F.avg("volume").over(trailing(30)),
    })
    up, down = F.col("low") > F.col("ph"), F.col("high") < F.col("pl")
    size = F.when(up, F.col("low") - F.col("ph")).when(down, F.col("pl") - F.col("high"))
    is_gap = F.coalesce((F.col(atr) > 0) & (size >= least * F.col(atr)), F.lit(False))
    b = b.withColumns({
        "is_gap": is_gap, "up": F.coalesce(up, F.lit(False)), "gap_low": F.when(up, F.col("ph")).otherwise(F.col("high")), "gap_high": F.when(up, F.col("low")).otherwise(F.col("pl")),
        "volume_ratio": F.when(F.col("mean_volume") > 0, F.col("volume") / F.col("mean_volume")).otherwise(1.0),
    })
    return b


def gaps(bars: DataFrame, atr: str = "atr", least: float = 0.25) -> DataFrame:
    """Gaps between a bar and the one before, and the first later bars that filled them and closed through them.

    Finding gaps is a window; what becomes of them is a scan that keeps the open ones in heaps, so a gap costs the
    logarithm of the open ones and not the bars after it.
    """
    return gap_fates(flagged_gaps(bars, atr, least))


class OpenGaps:
    """One side's open gaps: in order of the edge that price meets first, with a heap of the far edges that fill them.

    Edges are turned so that price comes from above: near is the edge it meets first, far the one that fills the gap.
    """

    def __init__(self):
        self.near: list[tuple[float, float, int]] = []
        self.far: list[tuple[float, float, int]] = []

    def add(self, near: float, far: float, i: int) -> None:
        bisect.insort(self.near, (near, far, i))
        heapq.heappush(self.far, (-far, near, i))

    def fill(self, reached: float) -> None:
        """Drop the gaps whose far edge is at ``reached`` or above."""
        while self.far and -self.far[0][0] >= reached:
            far, near, i = heapq.heappop(self.far)
            del self.near[bisect.bisect_left(self.near, (near, -far, i))]

    def nearest(self, price: float) -> tuple[float | None, float | None]:
        """(near, far) of the gap whose near edge is the highest at or under price; of several the one with the highest far edge."""
        k = bisect.bisect_right(self.near, (price, float("inf"), 0))
        return self.near[k - 1][:2] if k else (None, None)


def open_gap_step(sides: tuple[OpenGaps, OpenGaps], r: dict) -> tuple[tuple[OpenGaps, OpenGaps], list[tuple]]:
    """A bar fills gaps, then may leave one; then its close looks for the nearest. Gaps above are kept upside down."""
    below, above = sides
    below.fill(r["low"])
    above.fill(-r["high"])
    if r["is_gap"]:
        if r["up"]:
            below.add(r["gap_high"], r["gap_low"], r["i"])
        else:
            above.add(-r["gap_low"], -r["gap_high"], r["i"])
    high, low = below.nearest(r["close"])
    over, top = above.nearest(-r["close"])
    return sides, [(r["ts"], len(below.near) + len(above.near), low, high, None if over is None else -over, None if top is None else -top)]


def open_gaps(bars: DataFrame, atr: str = "atr", least: float = 0.25) -> DataFrame:
    """(symbol, ts, n_open, support_low, support_high, resistance_low, resistance_high) of each bar.

    Support is the open up-gap with the highest upper edge at or under the close, resistance the open down-gap with the lowest
    lower edge at or above it; nulls where there is none. A gap is open until a later bar reaches its far edge. Bars stream
    past in Arrow batches; a symbol's open gaps are kept in order, so a bar costs their logarithm.
    """
    b = flagged_gaps(bars, atr, least).select("symbol", "ts", "i", "high", "low", "close", "is_gap", "up", "gap_low", "gap_high")
    kind = dict(bars.dtypes)["ts"]
    return scan_stacked([b], [], lambda: (OpenGaps(), OpenGaps()), open_gap_step, f"ts {kind}, n_open long, support_low double, support_high double, resistance_low double, resistance_high double")


def gap_type(volume_ratio: Column, move_bars: Column, breakout: Column, heavy: float = 1.5) -> Column:
    fresh = breakout | ((volume_ratio >= heavy) & (move_bars <= 3)) | (move_bars <= 2)
    middle = (move_bars > 3) & (move_bars <= 40)
    return F.when(fresh, "breakaway").when(middle & (volume_ratio >= heavy * 1.6), "exhaustion").when(middle, "runaway").when(move_bars > 40, "exhaustion").otherwise("common")


def reversal_bars(bars: DataFrame, window: int = 20) -> DataFrame:
    """Bars at a new extreme of the window that close against the move."""
    w, prior = by_symbol(), by_symbol().rowsBetween(-window, -1)
    df = bars.withColumns({
        "eh": F.max("high").over(trailing(window)), "el": F.min("low").over(trailing(window)), "pc": F.lag("close").over(w), "ph": F.lag("high").over(w), "pl": F.lag("low").over(w),
        "ar": F.avg(F.col("high") - F.col("low")).over(prior), "av": F.avg("volume").over(prior),
    })
    kind = F.when((F.col("high") >= F.col("eh") - EPS) & (F.col("close") < F.col("pc")), "top").when((F.col("low") <= F.col("el") + EPS) & (F.col("close") > F.col("pc")), "bottom")
    rr = F.when(F.col("ar") > 0, (F.col("high") - F.col("low")) / F.col("ar")).otherwise(1.0)
    vr = F.when(F.col("av") > 0, F.col("volume") / F.col("av")).otherwise(1.0)
    outside = (F.col("high") > F.col("ph")) & (F.col("low") < F.col("pl"))
    sure = 0.25 + F.least(F.lit(0.3), 0.15 * rr) + F.least(F.lit(0.3), 0.15 * vr) + F.when(outside, 0.15).otherwise(0.0)
    return df.select("symbol", "ts", kind.alias("kind"), outside.alias("outside"), F.least(sure, F.lit(1.0)).alias("significance"), ((kind == "bottom") & (vr >= 1.8)).alias("is_climax")).where("kind IS NOT NULL")


def divergence(pivots: DataFrame, bars: DataFrame, oscillator: str) -> DataFrame:
    """Pivots beyond the one of their kind before, while the oscillator at confirmation went the other way."""
    osc = numbered(bars).select("symbol", F.col("i").alias("confirmed_index"), oscillator)
    w = Window.partitionBy("symbol", "kind").orderBy("confirmed_index")
    df = pivots.join(osc, ["symbol", "confirmed_index"]).withColumns({"pp": F.lag("price").over(w), "po": F.lag(oscillator).over(w)})
    bearish = (F.col("kind") == "peak") & (F.col("price") > F.col("pp")) & (F.col(oscillator) < F.col("po"))
    bullish = (F.col("kind") == "trough") & (F.col("price") < F.col("pp")) & (F.col(oscillator) > F.col("po"))
    return df.withColumn("bias", F.when(bearish, "bearish").when(bullish, "bullish")).where("bias IS NOT NULL")


def divergence_counts(pivots: DataFrame, bars: DataFrame, oscillators: list[str]) -> DataFrame:
    """Each pivot with how many oscillators at its confirmation went the other way than price since the pivot of its kind before."""
    osc = numbered(bars).select("symbol", F.col("i").alias("confirmed_index"), *oscillators)
    w = Window.partitionBy("symbol", "kind").orderBy("confirmed_index")
    peak, before = F.col("kind") == "peak", F.lag("price").over(w)
    beyond = F.when(peak, F.col("price") > before).otherwise(F.col("price") < before)
    against = [F.when(F.when(peak, F.col(o) < F.lag(o).over(w)).otherwise(F.col(o) > F.lag(o).over(w)), 1).otherwise(0) for o in oscillators]
    return pivots.join(osc, ["symbol", "confirmed_index"]).withColumn("diverging", F.when(beyond, sum(against[1:], against[0])).otherwise(0))


def extremes_since_pivot(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """Highest high and lowest low of each symbol since the last pivot was known, the bar that made it known included."""
    known = pivots.select("symbol", F.col("confirmed_index").alias("i"), F.lit(1).alias("_p"))
    df = numbered(bars).join(known, ["symbol", "i"], "left")
    df = df.withColumn("session", F.sum(F.coalesce("_p", F.lit(0))).over(so_far()))
    w = Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"high_since": F.max("high").over(w), "low_since": F.min("low").over(w)}).drop("_p")


def speed_zone(pivots: DataFrame) -> DataFrame:
    """Each pivot against the speed lines of the leg before it: where its price lies between origin and extreme."""
    w = Window.partitionBy("symbol").orderBy("confirmed_index")
    df = pivots.withColumns({"o": F.lag("price", 2).over(w), "o_at": F.lag("index", 2).over(w), "e": F.lag("price", 1).over(w), "e_at": F.lag("index", 1).over(w)}).where("o IS NOT NULL")
    args = [F.col(c) for c in ("o", "o_at", "e", "e_at", "index")]
    third, two = speed_line(*args, 1 / 3), speed_line(*args, 2 / 3)
    up, px = F.col("e") > F.col("o"), F.col("price")
    rising = F.when(px >= two, "above_2/3").when(px >= third, "between").otherwise("below_1/3")
    falling = F.when(px <= two, "below_2/3").when(px <= third, "between").otherwise("above_1/3")
    return df.select("symbol", "confirmed_index", third.alias("third"), two.alias("two_thirds"), F.when(up, rising).otherwise(falling).alias("zone"))


def islands(gaps_: DataFrame, bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Gaps that follow one the other way within so many bars, and leave an island between them."""
    at = numbered(bars).select("symbol", "ts", "i")
    w = Window.partitionBy("symbol").orderBy("i")
    g = gaps_.join(at, ["symbol", "ts"]).withColumns({"_up": F.lag("up").over(w), "_i": F.lag("i").over(w)})
    return g.where((F.col("_up") != F.col("up")) & (F.col("i") - F.col("_i") <= lookback)).select("symbol", "ts", F.when(F.col("up"), "bottom").otherwise("top").alias("island"), (F.col("i") - F.col("_i")).alias("bars_apart"))


def typed_gaps(gaps_: DataFrame, bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """Gaps with the bars that the move has lasted (since the last known pivot's place), their type, and a runaway gap's objective: as far again."""
    at = numbered(bars).select("symbol", "ts", "i")
    known = pivots.select("symbol", F.col("confirmed_index").alias("i"), F.struct(F.col("index").alias("at"), "price").alias("p"))
    df = at.join(known, ["symbol", "i"], "left").withColumn("p", F.last("p", ignorenulls=True).over(so_far()))
    g = gaps_.join(df, ["symbol", "ts"]).withColumn("move_bars", F.coalesce(F.col("i") - F.col("p.at"), F.lit(0)))
    kind = gap_type(F.col("volume_ratio"), F.col("move_bars"), F.lit(False))
    mid = (F.col("gap_low") + F.col("gap_high")) / 2
    return g.select("symbol", "ts", "move_bars", kind.alias("type"), F.when(kind == "runaway", 2 * mid - F.col("p.price")).alias("objective"))
