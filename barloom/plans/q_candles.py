"""Candlestick signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.functions import indicators as I
from barloom.operators import candles as C
from barloom.operators import kernels as K
from barloom.operators import multiframe as M
from barloom.operators import structure as S
from barloom.plans.q_structure import TREND
from barloom.plans.q_windows import bars
from barloom.plans.registry import query
from barloom.plans.sql import ORDER, with_bars
from barloom.session import materialise


def with_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the sign of the Dow trend as each one's trend, a written table."""
    b = materialise(I.atr(bars(spark, sf)), "barloom/bars")  # pivots, trend and signals read them
    way = S.dow_trend(b, K.swings(b)).select("symbol", "ts", M.sign_of(F.col("direction")).alias("prior_trend"))
    return materialise(b.drop("atr").join(way, ["symbol", "ts"]), "barloom/trended")


def _anatomy(k: str) -> str:
    return f"""greatest(o{k}, c{k}) AS top{k}, least(o{k}, c{k}) AS bot{k}, abs(c{k} - o{k}) AS body{k}, h{k} - l{k} AS rng{k}, c{k} > o{k} AS white{k}, c{k} < o{k} AS black{k}, (o{k} + c{k}) / 2 AS mid{k},
  h{k} - greatest(o{k}, c{k}) AS up{k}, least(o{k}, c{k}) - l{k} AS dn{k}, (h{k} - l{k} <= 0 OR abs(c{k} - o{k}) / nullif(h{k} - l{k}, 0) <= 0.08) AS doji{k}, abs(c{k} - o{k}) <= 0.5::DOUBLE * avg_body AS small{k}, abs(c{k} - o{k}) >= 1.3::DOUBLE * avg_body AS long{k}"""


_K = "greatest(least({}, 1), 0.2)"
#: kind, bias, sessions, reversal, condition, strength
_RULES = [
    ("hammer", 1, 1, 1, "umbrella AND t < 0", _K.format("dn0 / rng0")),
    ("hanging_man", -1, 1, 1, "umbrella AND t > 0", _K.format("dn0 / rng0")),
    ("shooting_star", -1, 1, 1, "inverted AND t > 0", _K.format("up0 / rng0")),
    ("inverted_hammer", 1, 1, 1, "inverted AND t < 0", _K.format("up0 / rng0")),
    ("dragonfly_doji", 1, 1, 1, "dragonfly", _K.format("dn0 / rng0")),
    ("gravestone_doji", -1, 1, 1, "gravestone", _K.format("up0 / rng0")),
    ("long_legged_doji", 0, 1, 1, "legged", "0.3"),
    ("doji", 0, 1, 1, "doji0 AND NOT coalesce(dragonfly OR gravestone OR legged, false)", "0.3"),
    ("marubozu_white", 1, 1, 1, "long0 AND bare0 AND white0", _K.format("0.4::DOUBLE + 0.3::DOUBLE * body0 / avg_body")),
    ("marubozu_black", -1, 1, 1, "long0 AND bare0 AND NOT white0", _K.format("0.4::DOUBLE + 0.3::DOUBLE * body0 / avg_body")),
    ("belt_hold_bullish", 1, 1, 1, "long0 AND rng0 > 0 AND white0 AND dn0 <= 0.1::DOUBLE * rng0", _K.format("body0 / rng0")),
    ("belt_hold_bearish", -1, 1, 1, "long0 AND rng0 > 0 AND black0 AND up0 <= 0.1::DOUBLE * rng0", _K.format("body0 / rng0")),
    ("spinning_top", 0, 1, 1, "NOT doji0 AND body0 > 0 AND small0 AND up0 > body0 AND dn0 > body0", "0.3"),
    ("kicking_bullish", 1, 2, 1, "long1 AND long0 AND bare1 AND bare0 AND black1 AND white0 AND l0 > h1", "0.9"),
    ("kicking_bearish", -1, 2, 1, "long1 AND long0 AND bare1 AND bare0 AND white1 AND black0 AND h0 < l1", "0.9"),
    ("dark_cloud_cover", -1, 2, 1, "long1 AND white1 AND black0 AND o0 > h1 AND c0 <= mid1 AND c0 >= bot1", _K.format("0.3::DOUBLE + 0.7::DOUBLE * (top1 - c0) / body1")),
    ("piercing_line", 1, 2, 1, "long1 AND black1 AND white0 AND o0 < l1 AND c0 >= mid1 AND c0 <= top1", _K.format("0.3::DOUBLE + 0.7::DOUBLE * (c0 - bot1) / body1")),
    ("engulfing_bullish", 1, 2, 1, "eng0 AND white0 AND black1", "CASE WHEN body1 <= 0 THEN 0.5 ELSE " + _K.format("0.4::DOUBLE + 0.3::DOUBLE * (body0 / body1 - 1)") + " END"),
    ("engulfing_bearish", -1, 2, 1, "eng0 AND black0 AND white1", "CASE WHEN body1 <= 0 THEN 0.5 ELSE " + _K.format("0.4::DOUBLE + 0.3::DOUBLE * (body0 / body1 - 1)") + " END"),
    ("doji_star_bearish", -1, 2, 1, "long1 AND doji0 AND white1 AND bot0 > top1", "0.6"),
    ("doji_star_bullish", 1, 2, 1, "long1 AND doji0 AND black1 AND top0 < bot1", "0.6"),
    ("harami_cross_bullish", 1, 2, 1, "har0 AND doji0 AND black1", "0.65"),
    ("harami_cross_bearish", -1, 2, 1, "har0 AND doji0 AND white1", "0.65"),
    ("harami_bullish", 1, 2, 1, "har0 AND NOT doji0 AND black1", "0.45"),
    ("harami_bearish", -1, 2, 1, "har0 AND NOT doji0 AND white1", "0.45"),
    ("tweezer_bottom", 1, 2, 1, "twb", "0.4"),
    ("tweezer_top", -1, 2, 1, "NOT twb AND patr > 0 AND abs(h0 - h1) <= 0.1::DOUBLE * patr AND h0 > greatest(c1, c0)", "0.4"),
    ("evening_star", -1, 3, 1, "eve AND NOT doji1", "least(0.55::DOUBLE + 0.35::DOUBLE * greatest(least((top2 - c0) / body2, 1), 0), 1)"),
    ("evening_doji_star", -1, 3, 1, "eve AND doji1", "least(0.6::DOUBLE + 0.35::DOUBLE * greatest(least((top2 - c0) / body2, 1), 0), 1)"),
    ("morning_star", 1, 3, 1, "mor AND NOT doji1", "least(0.55::DOUBLE + 0.35::DOUBLE * greatest(least((c0 - bot2) / body2, 1), 0), 1)"),
    ("morning_doji_star", 1, 3, 1, "mor AND doji1", "least(0.6::DOUBLE + 0.35::DOUBLE * greatest(least((c0 - bot2) / body2, 1), 0), 1)"),
    ("three_outside_up", 1, 3, 1, "eng1 AND white1 AND black2 AND white0 AND c0 > c1", "0.8"),
    ("three_outside_down", -1, 3, 1, "eng1 AND black1 AND white2 AND black0 AND c0 < c1", "0.8"),
    ("three_inside_up", 1, 3, 1, "har1 AND black2 AND white0 AND c0 > top2", "0.7"),
    ("three_inside_down", -1, 3, 1, "har1 AND white2 AND black0 AND c0 < bot2", "0.7"),
    ("three_white_soldiers", 1, 3, 0, "stairs AND white2 AND white1 AND white0 AND c1 > c2 AND c0 > c1", "0.75"),
    ("three_black_crows", -1, 3, 0, "stairs AND black2 AND black1 AND black0 AND c1 < c2 AND c0 < c1", "0.75"),
]


def _signals() -> tuple[str, ...]:
    pick = []
    for kind, bias, sessions, reversal, holds, strength in _RULES:
        if sessions == 1 and strength != "0.3":
            strength = f"CASE WHEN rng0 <= 0 THEN 0.3 ELSE {strength} END"
        admit = "true" if not bias else f"t = {-bias if reversal else bias}"
        pick.append(f"SELECT symbol, ts, '{kind}' AS kind, {bias} AS bias, {sessions} AS sessions, CAST({strength} AS DOUBLE) AS s, vr FROM k WHERE ({holds}) AND {admit}")
    lag = ", ".join(f"lag({c}, {k}) OVER ({ORDER}) AS {c[0]}{k}" for c in ("open", "high", "low", "close") for k in (1, 2))
    return (
        *TREND,
        f"""x AS (SELECT b.symbol, b.ts, b.n, b.volume, open AS o0, high AS h0, low AS l0, close AS c0, {lag}, (SELECT CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END FROM te WHERE te.symbol = b.symbol AND te.n = b.n) AS t,
  coalesce(avg(abs(close - open)) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS avg_body, coalesce(avg(volume) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS avg_volume FROM b)""",
        f"y AS (SELECT x.*, coalesce(a.v, 0) AS patr, CASE WHEN avg_volume <= 0 THEN 1 ELSE volume / avg_volume END AS vr, {_anatomy('0')}, {_anatomy('1')}, {_anatomy('2')} FROM x LEFT JOIN a ON a.symbol = x.symbol AND a.n = x.n - 1 WHERE avg_body > 0)",
        """zz AS (SELECT *, up0 <= 0.1::DOUBLE * rng0 AND dn0 <= 0.1::DOUBLE * rng0 AND rng0 > 0 AS bare0, up1 <= 0.1::DOUBLE * rng1 AND dn1 <= 0.1::DOUBLE * rng1 AND rng1 > 0 AS bare1,
  NOT doji0 AND body0 > 0 AND rng0 > 0 AND small0 AND dn0 >= 2 * body0 AND up0 <= 0.1::DOUBLE * rng0 AS umbrella, NOT doji0 AND body0 > 0 AND rng0 > 0 AND small0 AND up0 >= 2 * body0 AND dn0 <= 0.1::DOUBLE * rng0 AS inverted,
  doji0 AND rng0 > 0 AND up0 / nullif(rng0, 0) <= 0.1 AND dn0 / nullif(rng0, 0) >= 0.6 AS dragonfly, doji0 AND rng0 > 0 AND dn0 / nullif(rng0, 0) <= 0.1 AND up0 / nullif(rng0, 0) >= 0.6 AS gravestone, doji0 AND rng0 > 0 AND up0 / nullif(rng0, 0) >= 0.3 AND dn0 / nullif(rng0, 0) >= 0.3 AS legged,
  NOT doji1 AND NOT doji0 AND top0 >= top1 AND bot0 <= bot1 AND body0 > body1 AS eng0, NOT doji2 AND NOT doji1 AND top1 >= top2 AND bot1 <= bot2 AND body1 > body2 AS eng1,
  long1 AND top0 <= top1 AND bot0 >= bot1 AND small0 AS har0, long2 AND top1 <= top2 AND bot1 >= bot2 AND small1 AS har1, patr > 0 AND abs(l0 - l1) <= 0.1::DOUBLE * patr AND l0 < least(c1, c0) AS twb FROM y)""",
        """k AS MATERIALIZED (SELECT *, small1 AND long2 AND long0 AND white2 AND black0 AND bot1 > top2 AND c0 <= mid2 AS eve, small1 AND long2 AND long0 AND black2 AND white0 AND top1 < bot2 AND c0 >= mid2 AS mor,
  long2 AND long1 AND long0 AND o1 BETWEEN bot2 AND top2 AND o0 BETWEEN bot1 AND top1 AS stairs FROM zz)""",
        "s0 AS (" + "\nUNION ALL\n".join(pick) + ")",
        "s AS (SELECT symbol, ts, kind, bias, sessions, vr, CASE WHEN vr >= 1.5 THEN least(s * 1.15::DOUBLE, 1) WHEN vr < 0.7 AND bias > 0 THEN s * 0.85::DOUBLE ELSE s END AS s FROM s0)",
    )


@query(with_bars("SELECT symbol, ts, kind, bias, sessions, round(s, 6) AS strength, round(vr, 6) AS volume_ratio FROM s WHERE s >= 0.35", *_signals(), recursive=True))
def candle_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = C.candle_signals(with_trend(spark, sf))
    return s.select("symbol", "ts", "kind", "bias", "sessions", F.round("strength", 6).alias("strength"), F.round("volume_ratio", 6).alias("volume_ratio"))


@query(
    with_bars(
        """SELECT symbol, ts, round(CASE WHEN coalesce(sum(w) OVER o, 0) <= 0 THEN 0 ELSE sum(s) OVER o / sum(w) OVER o END, 6) AS net_bias FROM (SELECT b.symbol, b.ts, p.s, p.w FROM b LEFT JOIN p ON p.symbol = b.symbol AND p.ts = b.ts)
WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
        *_signals(),
        "p AS (SELECT symbol, ts, sum(s * bias) AS s, sum(s) AS w FROM s WHERE s >= 0.35 AND bias <> 0 GROUP BY 1, 2)",
        recursive=True,
    )
)
def candle_net_bias(spark: SparkSession, sf: str) -> DataFrame:
    b = with_trend(spark, sf)
    n = C.net_bias(b, C.candle_signals(b))
    return n.select("symbol", "ts", F.round("net_bias", 6).alias("net_bias"))
