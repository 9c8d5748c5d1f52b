"""Elliott wave counts over confirmed pivots, by lags and arrays.

Every window of pivots is a candidate by itself, so a pivot's row holds those that end in it, and the last twelve pivots'
candidates are a window of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIOS = (0.382, 0.50, 0.618, 0.667)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _candidate(size: int, kind: str) -> Column:
    """The count of the last ``size`` pivots, or null if they make none; p0 is the newest price, p1 the one before it."""
    p = [F.col(f"p{k}") for k in range(size - 1, -1, -1)]  # oldest first
    kinds = [F.col(f"k{k}") for k in range(size - 1, -1, -1)]
    legs = [b - a for a, b in zip(p, p[1:])]
    up = legs[0] > 0
    length = [F.abs(x) for x in legs]
    shape_ok = _all([a != b for a, b in zip(kinds, kinds[1:])])
    ways = _all([(x > 0) == (up if i % 2 == 0 else ~up) for i, x in enumerate(legs)])
    net = p[-1] - p[0]
    ok = p[0].isNotNull() & shape_ok & ways & F.when(up, net > 0).otherwise(net < 0)
    n = len(legs)
    problems = []
    if kind == "impulse":
        if n >= 2:
            problems.append(F.when(length[1] >= length[0], "wave 2 retraced all of wave 1"))
        if n >= 5:
            problems.append(F.when((length[2] < length[0]) & (length[2] < length[4]), "wave 3 is the shortest"))
        if n >= 4:
            problems.append(F.when(F.when(up, p[4] < p[1]).otherwise(p[4] > p[1]), "wave 4 overlaps wave 1"))
    broken = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    score = F.lit(0.45) + (0.2 if n >= (5 if kind == "impulse" else 3) else 0.0)
    if kind == "impulse" and n >= 3:
        score = score + F.when(length[2] > length[0], 0.15 + (F.when(length[2] > length[4], 0.1).otherwise(0.0) if n >= 5 else F.lit(0.0))).otherwise(0.0)
    sure = F.when(F.size(broken) > 0, F.greatest(0.35 - 0.15 * F.size(broken), F.lit(0.0))).otherwise(F.least(score, F.lit(1.0)))
    ratio = F.when(length[0] <= 1e-12, 0.0).otherwise(length[1] / length[0]) if n >= 2 else F.lit(0.0)
    shape = F.when(length[0] <= 1e-12, "unknown").when(ratio >= 0.8, "flat").when(ratio <= 0.6, "zigzag").otherwise("unknown") if kind == "correction" else F.lit("unknown")
    nothing = F.lit(None).cast("double")
    return F.when(
        ok,
        F.struct(
            sure.alias("confidence"), F.lit(n).alias("waves"), F.lit(kind).alias("kind"), up.alias("up"), shape.alias("shape"), broken.alias("violations"), p[0].alias("start"), p[1].alias("w1_end"),
            (p[2] if n >= 2 else nothing).alias("w2_end"), p[-1].alias("end"), p[-2].alias("before_end"),
        ),
    )


def elliott_counts(pivots: DataFrame) -> DataFrame:
    """Each pivot with the best six counts of the last twelve pivots: surest first, then those of more waves."""
    w = Window.partitionBy("symbol").orderBy("confirmed_index")
    df = pivots.withColumns({f"p{k}": F.lag("price", k).over(w) for k in range(6)} | {f"k{k}": F.lag("kind", k).over(w) for k in range(6)})
    df = df.withColumns({"c6": _candidate(6, "impulse"), "c4": _candidate(4, "correction"), "c5": _candidate(5, "impulse"), "c4p": _candidate(4, "impulse"), "c3": _candidate(3, "impulse")})

    df = df.withColumn("_rn", F.row_number().over(w))
    # Candidates that end in this and earlier pivots, the newest first among equals.
    here = lambda c, rows, group: F.transform(
        F.filter(F.collect_list(F.struct("_rn", F.col(c).alias("c"))).over(w.rowsBetween(-rows, 0)), lambda x: x["c"].isNotNull()),
        lambda x: F.struct((-x["c"]["confidence"]).alias("a"), (-x["c"]["waves"]).alias("b"), F.lit(group).alias("g"), (-x["_rn"]).alias("n"), x["c"].alias("c")),
    )
    pool = F.concat(here("c6", 6, 0), here("c4", 8, 1), here("c5", 0, 2), here("c4p", 0, 3), here("c3", 0, 4))
    best = F.transform(F.slice(F.array_sort(pool), 1, 6), lambda x: x["c"])
    return df.select("symbol", "confirmed_index", "kind", "price", best.alias("counts"))


def elliott_best(counts: DataFrame) -> DataFrame:
    """The best count of each pivot with its bias and price targets."""
    b = F.get("counts", F.lit(0))
    df = counts.withColumn("b", b).where("b IS NOT NULL")
    impulse, up = F.col("b.kind") == "impulse", F.col("b.up")
    turned = F.when(impulse, F.col("b.waves") >= 5).otherwise(True)
    bias = F.when(F.col("b.confidence") < 0.4, "neutral").when(up != turned, "bullish").otherwise("bearish")
    sign = F.when(up, 1.0).otherwise(-1.0)
    w1 = F.abs(F.col("b.w1_end") - F.col("b.start"))
    lo, hi = F.least("b.start", "b.w1_end"), F.greatest("b.start", "b.w1_end")
    motive = F.col("b.waves") % 2 == 1
    last = F.abs(F.col("b.end") - F.col("b.before_end"))
    back = F.when(F.col("b.end") > F.col("b.before_end"), -1.0).otherwise(1.0)
    columns = {
        "wave3_min": F.when(impulse & F.col("b.w2_end").isNotNull(), F.col("b.w2_end") + sign * w1 * 1.618),
        "wave5_min": F.when(impulse, F.when(up, lo + w1 * 3.236).otherwise(hi - w1 * 3.236)),
        "wave5_max": F.when(impulse, F.when(up, hi + w1 * 3.236).otherwise(lo - w1 * 3.236)),
    } | {f"retrace_{int(r * 1000)}": F.when(motive, F.col("b.end") + back * last * r) for r in RATIOS}
    return df.select("symbol", "confirmed_index", "b.kind", "b.up", "b.waves", "b.confidence", "b.shape", F.size("b.violations").alias("n_violations"), bias.alias("bias"), *[v.alias(k) for k, v in columns.items()])
