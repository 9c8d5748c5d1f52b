"""Automata that no window can express, as step functions.

A step takes the state and a bar and returns the new state and what the bar brings. Batch plans run it over each symbol's
bars in order; streaming plans keep the state between batches. Both go the same way through the same code.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.session import ship_package

# --- parabolic stop and reverse ---


def sar_start() -> dict:
    return {"n": 0, "sar": 0.0, "ep": 0.0, "af": 0.0, "long": True, "h1": 0.0, "l1": 0.0, "h2": 0.0, "l2": 0.0}


def sar_step(s: dict, high: float, low: float, start: float = 0.02, step: float = 0.02, most: float = 0.20) -> tuple[dict, dict]:
    """The stop follows the extreme with growing speed, stays beyond the last two bars, and turns over when it is hit."""
    if not s["n"]:
        now = {"n": 1, "sar": low, "ep": high, "af": start, "long": True, "h1": high, "l1": low, "h2": high, "l2": low}
        return now, {"sar": low, "is_long": True, "flipped": False}
    sar = s["sar"] + s["af"] * (s["ep"] - s["sar"])
    up, ep, af = s["long"], s["ep"], s["af"]
    sar = min(sar, s["l1"], s["l2"]) if up else max(sar, s["h1"], s["h2"])
    extreme = high if up else low
    hit = low <= sar if up else high >= sar
    if hit:
        sar, ep, af, up = ep, (low if up else high), start, not up
    elif (extreme > ep) if up else (extreme < ep):
        ep, af = extreme, min(af + step, most)
    now = {"n": s["n"] + 1, "sar": sar, "ep": ep, "af": af, "long": up, "h1": high, "l1": low, "h2": s["h1"], "l2": s["l1"]}
    return now, {"sar": sar, "is_long": up, "flipped": hit}


# --- confirmed swings ---


def swing_start() -> dict:
    return {"i": -1, "seek": 0, "price": 0.0, "at": -1, "volume": 0.0, "hi": None, "lo": None}


def swing_step(s: dict, high: float, low: float, close: float, volume: float, atr: float, mult: float = 1.5, least: float = 0.002) -> tuple[dict, dict | None]:
    """A peak or trough is confirmed once price has come back from it by the threshold; at most one at a bar.

    seek: 1 while a peak forms, -1 while a trough does, 0 before the first pivot, when both extremes are kept.
    """
    s = {**s, "i": s["i"] + 1}
    i = s["i"]
    gap = max(mult * atr, least * max(close, 1e-9))
    if gap <= 0:
        return s, None

    def turn(kind: str, price: float, at: int, vol: float) -> tuple[dict, dict]:
        seek, edge = (-1, low) if kind == "peak" else (1, high)
        pivot = {"index": at, "price": price, "kind": kind, "confirmed_index": i, "volume": vol, "confirm_atr": gap / atr if atr > 0 else 0.0}
        return {**s, "seek": seek, "price": edge, "at": i, "volume": volume}, pivot

    if not s["seek"]:
        if s["hi"] is None:
            s["hi"] = s["lo"] = (close, i, volume)
            return s, None
        if high > s["hi"][0]:
            s["hi"] = (high, i, volume)
        if low < s["lo"][0]:
            s["lo"] = (low, i, volume)
        fell, rose = s["hi"][0] - low >= gap, high - s["lo"][0] >= gap
        if fell and (s["hi"][1] <= s["lo"][1] or not rose):
            return turn("peak", *s["hi"])
        return turn("trough", *s["lo"]) if rose else (s, None)
    up = s["seek"] > 0
    edge = high if up else low
    if (edge > s["price"]) if up else (edge < s["price"]):
        return {**s, "price": edge, "at": i, "volume": volume}, None
    back = s["price"] - low if up else high - s["price"]
    return turn("peak" if up else "trough", s["price"], s["at"], s["volume"]) if back >= gap else (s, None)


# --- running a step over bars ---


def scan(bars: DataFrame, start: Callable[[], dict], step: Callable[[dict, tuple], tuple[dict, dict | None]], columns: list[str], schema: str, keep: list[str] | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a step brings, bar by bar in each symbol; keep: columns of the bar that go along.

    Bars of one ts are taken in order of ``then``; those without a ts come last. They stream past in Arrow batches, so memory
    holds a symbol's state and not its history. A step has NaN for a number that is null, and NaN comes out as null.
    """
    ship_package(bars.sparkSession)
    keep = ["symbol", "ts"] if keep is None else keep
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    kinds = [f.type for f in arrow][len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = state = None
        begun = False
        for b in batches:
            at, rows = [], []
            values = zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns))
            for k, (own, v) in enumerate(zip(b.column("symbol").to_pylist(), values)):
                if not begun or own != symbol:
                    symbol, state, begun = own, start(), True
                state, out = step(state, v)
                if out is not None:
                    at.append(k)
                    rows.append(tuple(out.values()))
            if rows:
                held = [b.column(c).take(pa.array(at, pa.int32())) for c in keep]
                made = [pa.array(c, kind, from_pandas=True) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(held + made, names=arrow.names)

    df = bars.select(*dict.fromkeys([*keep, "symbol", "ts", *columns, *then]))
    return df.repartition("symbol").sortWithinPartitions("symbol", F.col("ts").asc_nulls_last(), *then).mapInArrow(run, schema)


def scan_stacked(parts: list[DataFrame], then: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, list[tuple]]], schema: str) -> DataFrame:
    """Rows (symbol, *those of schema) that a step brings from the rows of several tables, in order of symbol and i.

    Each part has symbol and i; of rows of one i those of an earlier part come first, then those with smaller ``then``.
    Columns that only some parts have are null in the others. Rows stream past in Arrow batches, so memory holds a symbol's
    state and not its history.
    """
    stacked = parts[0].withColumn("_k", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        stacked = stacked.unionByName(part.withColumn("_k", F.lit(k)), allowMissingColumns=True)
    ship_package(stacked.sparkSession)
    out = T.StructType([stacked.schema["symbol"], *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = state = None
        begun = False
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if not begun or row["symbol"] != symbol:
                    symbol, state, begun = row["symbol"], start(), True
                state, made = step(state, row)
                rows += [(symbol, *m) for m in made]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return stacked.repartition("symbol").sortWithinPartitions("symbol", "i", "_k", *then).mapInArrow(run, out)


def parabolic_sar(bars: DataFrame) -> DataFrame:
    return scan(bars, sar_start, lambda s, v: sar_step(s, *v), ["high", "low"], f"symbol string, ts {dict(bars.dtypes)['ts']}, sar double, is_long boolean, flipped boolean")


def swings(bars: DataFrame, atr: str = "atr") -> DataFrame:
    """Pivots: place and price of the extreme, the bar that confirmed it, and the time of that bar."""
    ts = dict(bars.dtypes)["ts"]
    return scan(bars, swing_start, lambda s, v: swing_step(s, *v), ["high", "low", "close", "volume", atr], f"symbol string, ts {ts}, index int, price double, kind string, confirmed_index int, volume double, confirm_atr double")


def iterate(step: Callable, state: dict, rows: Iterator[tuple]) -> tuple[dict, list]:
    """The same loop over plain rows, for streams: the state after them and what they brought."""
    out = []
    for r in rows:
        state, got = step(state, r)
        if got is not None:
            out.append(got)
    return state, out


# --- gaps ---


def gap_fates(bars: DataFrame) -> DataFrame:
    """The rows of bars that are gaps, with the places of the first later bars that reach and close beyond their far side."""
    ship_package(bars.sparkSession)
    ts = dict(bars.dtypes)["ts"]
    columns = ["symbol", "ts", "i", "high", "low", "close", "is_gap", "up", "gap_low", "gap_high", "volume_ratio"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        rows: list[list] = []
        # Open gaps by their far side, nearest to price first: (side, row), for reaching it and for closing beyond it.
        reach: dict[bool, list] = {True: [], False: []}
        beyond: dict[bool, list] = {True: [], False: []}
        for symbol, t, i, high, low, close, is_gap, up, gap_low, gap_high, ratio in zip(*(pdf[c].tolist() for c in columns)):
            while reach[True] and low <= -reach[True][0][0]:
                rows[heapq.heappop(reach[True])[1]][6] = i
            while reach[False] and high >= reach[False][0][0]:
                rows[heapq.heappop(reach[False])[1]][6] = i
            while beyond[True] and close < -beyond[True][0][0]:
                rows[heapq.heappop(beyond[True])[1]][7] = i
            while beyond[False] and close > beyond[False][0][0]:
                rows[heapq.heappop(beyond[False])[1]][7] = i
            if is_gap:
                side = -gap_low if up else gap_high
                for heap in (reach, beyond):
                    heapq.heappush(heap[up], (side, len(rows)))
                rows.append([symbol, t, up, gap_low, gap_high, ratio, None, None])
        out = pd.DataFrame(rows, columns=["symbol", "ts", "up", "gap_low", "gap_high", "volume_ratio", "filled_at", "closed_through_at"])
        return out.astype({"filled_at": "Int64", "closed_through_at": "Int64"})

    return bars.select(*columns).groupBy("symbol").applyInPandas(run, f"symbol string, ts {ts}, up boolean, gap_low double, gap_high double, volume_ratio double, filled_at long, closed_through_at long")
