"""Fills, positions, ledgers, trades and whole simulations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.kernels import scan
from barloom.session import ship_package

EPS = 1e-12


# --- positions ---


def position_start() -> dict:
    return {"qty": 0.0, "avg": 0.0, "realised": 0.0}


def position_step(s: dict, signed: float, price: float) -> tuple[dict, dict]:
    """A fill opens or adds at the weighted mean price, or closes and realises; past flat it opens the other way at its own price."""
    qty, avg, gain = s["qty"], s["avg"], 0.0
    if abs(qty) < EPS:
        qty, avg = signed, price
    elif (qty > 0) == (signed > 0):
        avg = (avg * qty + price * signed) / (qty + signed)
        qty += signed
    else:
        gain = (price - avg) * min(abs(signed), abs(qty)) * math.copysign(1, qty)
        left = qty + signed
        if abs(left) < EPS:
            left, avg = 0.0, 0.0
        elif (left > 0) != (qty > 0):
            avg = price
        qty = left
    now = {"qty": qty, "avg": avg, "realised": s["realised"] + gain}
    return now, {"qty": qty, "avg_price": avg, "realised": now["realised"], "realised_now": gain}


def positions(fills: DataFrame, order: str = "ts") -> DataFrame:
    """Each fill (symbol, ts, signed, price) with the position after it."""
    ts = dict(fills.dtypes)[order]
    return scan(fills, position_start, lambda s, v: position_step(s, *v), ["signed", "price"], f"symbol string, ts {ts}, qty double, avg_price double, realised double, realised_now double")


def ledger(fills: DataFrame, start: float, order: list[str], commission_bps: float = 1.0) -> DataFrame:
    """fills with commission, each symbol's quantity and cash after them: sums, as cash only ever changes by fills."""
    fee = F.abs(F.col("signed")) * F.col("price") * commission_bps / 10_000
    df = fills.withColumn("commission", fee)
    w = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"qty": F.sum("signed").over(w), "cash": F.lit(start) - F.sum(F.col("signed") * F.col("price") + F.col("commission")).over(w)})


def marked(curve: DataFrame) -> DataFrame:
    """Equity, gross and net exposure at each time from (ts, symbol, cash, qty, close) rows as of that time."""
    value = F.col("qty") * F.col("close")
    return curve.groupBy("ts").agg(
        F.sum(F.col("cash") + value).alias("equity"), F.sum(F.abs(value)).alias("gross"), F.sum(value).alias("net"), F.count_if(F.abs("qty") > EPS).alias("open_positions")
    )


# --- orders against bars ---


def fill_orders(pending: list[dict], bar: dict, slip_bps: float = 2.0, fee_bps: float = 1.0, participation: float | None = None) -> tuple[list[dict], list[dict]]:
    """Fills at a bar's open, moved against the order, and what stays pending.

    A limit order waits until the bar reaches its limit and never fills worse than that. With participation no more than
    that share of the bar's volume fills; only what fills uses it up.
    """
    base = bar["open"] if bar["open"] > 0 else bar["close"]
    room = bar["volume"] * participation if participation is not None else math.inf
    fills, waiting = [], []
    for o in pending:
        side = 1 if o["qty"] > 0 else -1
        left, limit = abs(o["qty"]), o.get("limit")
        if base <= 0 or left <= 0:
            continue
        if limit is not None and (bar["low"] > limit if side > 0 else bar["high"] < limit):
            waiting.append(o)
            continue
        take = min(left, room)
        if take <= 0:
            waiting.append(o)
            continue
        price = base * (1 + side * slip_bps / 10_000)
        if limit is not None:
            price = min(price, limit) if side > 0 else max(price, limit)
        room -= take
        fills.append({**o, "qty": side * take, "price": price, "fee": take * price * fee_bps / 10_000, "risk": o.get("risk", 0.0) * take / left})
        if left - take > EPS:
            waiting.append({**o, "qty": side * (left - take), "risk": o.get("risk", 0.0) * (left - take) / left})
    return fills, waiting


# --- the way of a trade ---


def trade_step(t: dict, high: float, low: float, open_: float, close: float, bias: int, breakeven: float = 1.5, add: float = 1.0, trail_after: float = 2.0, trail: float = 1.5, layers: int = 3, age: int = 0, most_bars: int = 0) -> tuple[dict, str, float]:
    """The trade after a bar, what to do, and the price that a stop or target would give.

    The stop comes before the target, both before a turned signal and that before the trade's age (in bars, 0: no limit);
    only then does the best price so far move the stop, and never away from price. t: side, entry, stop, objective, risk
    (per unit at the start), best, layer, at_breakeven.
    """
    side, stop = t["side"], t["stop"]
    if low <= stop if side > 0 else high >= stop:
        gapped = open_ < stop if side > 0 else open_ > stop
        return t, "exit_stop", open_ if gapped else stop
    if t["objective"] > 0 and (high >= t["objective"] if side > 0 else low <= t["objective"]):
        return t, "exit_target", t["objective"]
    if bias == -side or (most_bars and age >= most_bars):
        return t, "exit_signal", close
    t = {**t, "best": max(t["best"], high) if side > 0 else min(t["best"], low)}

    def r(price: float) -> float:
        return (price - t["entry"]) * side / t["risk"] if t["risk"] > 0 else 0.0

    def tighten(to: float) -> bool:
        if (to > t["stop"]) if side > 0 else (to < t["stop"]):
            t["stop"] = to
            return True
        return False

    if r(t["best"]) >= breakeven and not t["at_breakeven"] and tighten(t["entry"]):
        t["at_breakeven"] = True
    if r(t["best"]) >= trail_after and t["risk"] > 0:
        tighten(t["best"] - side * trail * t["risk"])
    if bias == side and t["layer"] < layers and r(close) >= add:
        return t, "add", 0.0
    return t, "hold", 0.0


def add_layer(t: dict, held: float, qty: float, price: float) -> dict:
    """A trade of ``held`` units after another layer: its mean entry, which the stop moves up to if that is tighter."""
    entry = (t["entry"] * held + price * qty) / (held + qty)
    tighter = (entry - t["stop"]) * t["side"] > 0
    return {**t, "entry": entry, "layer": t["layer"] + 1, "stop": entry if tighter else t["stop"], "at_breakeven": t["at_breakeven"] or tighter}


# --- whole runs ---

RUN = "run_id string, ts {ts}, symbol string, event string, qty double, price double, pnl double, risk double, fees double, equity double, gross double, net double, open_positions int"


@dataclass(frozen=True)
class Desk:
    """Limits of a simulated account, as shares of its equity; those of exposure grow with a run's leverage."""

    risk: float = 0.005
    layer_decay: float = 0.5
    layers: int = 3
    order: float = 0.35
    symbol: float = 0.20
    gross: float = 1.0
    net: float = 0.6
    least: float = 25.0


def allowed(notional: float, position: float, gross: float, net: float, equity: float, leverage: float, desk: Desk) -> float:
    """What the limits leave of an order that opens or adds; nothing if that is too small to send."""
    e = equity * leverage
    side = math.copysign(1.0, notional)
    room = min(desk.order * e, desk.symbol * e - abs(position), desk.gross * e - gross, desk.net * e - side * net)
    size = min(abs(notional), max(room, 0.0))
    return side * size if size >= desk.least else 0.0


def simulate(bars: DataFrame, start: float = 100_000.0, slip_bps: float = 2.0, fee_bps: float = 1.0, stop_atr: float = 2.0, reward: float = 3.0, participation: float | None = None, most_bars: int = 0, desk: Desk = Desk()) -> DataFrame:
    """Runs over bars (run_id, symbol, ts, OHLCV, atr, weight[, conviction, leverage]): what a close decides fills at the next open.

    Without a trade a weight opens one, as large as the risk to its stop, the weight and the account's limits allow. With
    one, weights only give its bias: its stop, objective, a turned bias or its age (most_bars) end it, and winners get
    layers, each smaller than the one before. conviction scales sizes, leverage a run's limits; both are 1 where missing.

    Rows: 'equity' for every time, 'fill' for every fill, 'trade' for every closed trade (qty is its largest, risk what was
    planned when it opened and grew; exits carry none). Runs are independent and go to tasks of their own; within one, bars
    are taken in order of time and symbol, as its account is one.
    """
    ship_package(bars.sparkSession)
    ts = dict(bars.dtypes)["ts"]
    schema = RUN.format(ts=ts)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "symbol"], kind="stable")
        run_id, cash, rows = pdf["run_id"].iloc[0], start, []
        held: dict[str, dict] = {}
        mark: dict[str, float] = {}
        pending: dict[str, list[dict]] = {}
        trades: dict[str, dict] = {}
        paths: dict[str, dict] = {}

        def value(symbol: str) -> float:
            return held[symbol]["qty"] * mark.get(symbol, 0.0)

        def row(event, symbol, t, qty=0.0, price=0.0, pnl=0.0, risk=0.0, fees=0.0):
            worth = [value(s) for s in held]
            rows.append((run_id, t, symbol, event, qty, price, pnl, risk, fees, cash + sum(worth), sum(map(abs, worth)), sum(worth), sum(abs(h["qty"]) > EPS for h in held.values())))

        def book(symbol, t, fill):
            nonlocal cash
            q, px, fee = fill["qty"], fill["price"], fill["fee"]
            cash -= q * px + fee
            before = held.setdefault(symbol, position_start())
            held[symbol], done = position_step(before, q, px)
            mark.setdefault(symbol, px)
            row("fill", symbol, t, q, px, done["realised_now"], fill["risk"], fee)
            tr = trades.get(symbol)
            closing = abs(before["qty"]) > EPS and (before["qty"] > 0) != (q > 0)
            if not closing:
                tr = trades.setdefault(symbol, {"pnl": 0.0, "risk": 0.0, "fees": 0.0, "peak": 0.0})
                tr["fees"] += fee
                tr["risk"] += fill["risk"]
                tr["peak"] = max(tr["peak"], abs(held[symbol]["qty"]))
                return
            tr["pnl"] += done["realised_now"]
            shut = abs(before["qty"])
            part = min(1.0, shut / abs(q))
            tr["fees"] += fee * part
            if abs(held[symbol]["qty"]) < EPS or (held[symbol]["qty"] > 0) != (before["qty"] > 0):
                row("trade", symbol, t, tr["peak"], px, tr["pnl"] - tr["fees"], tr["risk"], tr["fees"])
                trades.pop(symbol)
                if abs(held[symbol]["qty"]) > EPS:
                    trades[symbol] = {"pnl": 0.0, "risk": fill["risk"], "fees": fee * (1 - part), "peak": abs(held[symbol]["qty"])}

        def size(symbol: str, c: float, gap: float, share: float, layer: int, lev: float) -> float:
            """Signed quantity of a first or further layer: by risk and weight, then by the account's limits."""
            worth = {s: value(s) for s in held}
            equity = cash + sum(worth.values())
            if not (gap > 0 and c > 0 and equity > 0):  # nor if one is NaN
                return 0.0
            qty = min(desk.risk * equity * lev / gap, abs(share) * equity * lev / c) * desk.layer_decay ** (layer - 1)
            now = worth.get(symbol, 0.0)
            room = allowed(math.copysign(qty * c, share), now, sum(map(abs, worth.values())), sum(worth.values()), equity, lev, desk)
            return room / c

        columns = ("ts", "symbol", "open", "high", "low", "close", "volume", "atr", "weight", "conviction", "leverage")
        for t, symbol, o, h, lo, c, v, atr, weight, sure, lev in zip(*(pdf[x].tolist() for x in columns)):
            fills, waiting = fill_orders(pending.pop(symbol, []), {"open": o, "high": h, "low": lo, "close": c, "volume": v}, slip_bps, fee_bps, participation)
            if waiting:
                pending[symbol] = waiting
            for f in fills:
                book(symbol, t, f)
            mark[symbol] = c
            qty = held.get(symbol, {"qty": 0.0})["qty"]
            bias = (weight > 0) - (weight < 0)
            path = paths.get(symbol)
            if path is not None:
                path["age"] += 1
                path, action, _ = trade_step(path, h, lo, o, c, bias, layers=desk.layers, age=path["age"], most_bars=most_bars)
                paths[symbol] = path
                if action.startswith("exit"):  # whatever still waits is withdrawn
                    paths.pop(symbol)
                    pending.pop(symbol, None)
                    if abs(qty) > EPS:
                        pending[symbol] = [{"qty": -qty, "risk": 0.0}]
                elif action == "add" and symbol not in pending and (c - path["entry"]) * path["side"] > 0:
                    more = size(symbol, c, stop_atr * atr, weight * sure, path["layer"] + 1, lev)
                    if more:
                        pending[symbol] = [{"qty": more, "risk": stop_atr * atr * abs(more)}]
                        paths[symbol] = add_layer(path, abs(qty), abs(more), c)
            elif bias and abs(qty) <= EPS and symbol not in pending:
                gap = stop_atr * atr
                first = size(symbol, c, gap, weight * sure, 1, lev)
                if first:
                    pending[symbol] = [{"qty": first, "risk": gap * abs(first)}]
                    paths[symbol] = {"side": bias, "entry": c, "stop": c - bias * gap, "objective": c + bias * reward * gap, "risk": gap, "best": c, "layer": 1, "at_breakeven": False, "age": 0}
            row("equity", symbol, t)
        for symbol, tr in list(trades.items()):  # marked out at the end
            open_gain = (mark[symbol] - held[symbol]["avg"]) * held[symbol]["qty"]
            row("trade", symbol, t, tr["peak"], mark[symbol], tr["pnl"] + open_gain - tr["fees"], tr["risk"], tr["fees"])
        return pd.DataFrame(rows, columns=names)

    for name in ("conviction", "leverage"):
        if name not in bars.columns:
            bars = bars.withColumn(name, F.lit(1.0))
    return bars.select("run_id", "symbol", "ts", "open", "high", "low", "close", "volume", "atr", "weight", "conviction", "leverage").groupBy("run_id").applyInPandas(run, schema)
