"""Statistics of bar returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import bars as B
from barloom.operators import regimes as Q
from barloom.operators import stats as S
from barloom.plans.q_metrics import rounded
from barloom.plans.registry import query
from barloom.plans.sql import BARS, ORDER, with_bars
from barloom.session import materialise


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Close-to-close returns; none for the first bar or after a close of nothing."""
    before = F.lag("close").over(B.by_symbol())
    b = B.event_bars(spark, sf).withColumn("ret", F.when(before > 1e-9, F.round(F.col("close") / before - 1, 9)))
    return b.where("ret IS NOT NULL").select("symbol", "ts", "close", "ret")


RETURNS = f"{BARS}, r AS MATERIALIZED (SELECT symbol, ts, n, close, round(close / p - 1, 9) AS ret FROM (SELECT *, lag(close) OVER ({ORDER}) AS p FROM b) WHERE p > 1e-9)"


@query(
    f"""WITH {RETURNS}, q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1, avg(ret) AS m FROM r GROUP BY symbol),
g AS (SELECT r.symbol, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(pow(ret - m, 3)) / pow(stddev_pop(ret), 3) AS skew, avg(pow(ret - m, 4)) / pow(stddev_pop(ret), 4) - 3 AS k, max(ret) AS best, min(ret) AS worst, any_value(q5) AS q5, any_value(q1) AS q1,
  avg(CASE WHEN ret <= q5 THEN ret END) AS c5, avg(CASE WHEN ret <= q1 THEN ret END) AS c1 FROM r JOIN q ON q.symbol = r.symbol GROUP BY r.symbol)
SELECT symbol, n, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew, round(k, 6) AS excess_kurtosis, round(best, 6) AS best, round(worst, 6) AS worst, round(q5, 6) AS var_95, round(q1, 6) AS var_99, round(c5, 6) AS cvar_95, round(c1, 6) AS cvar_99,
  round(exp(-(n / 6.0::DOUBLE * (skew * skew + k * k / 4)) / 2), 6) AS jarque_bera_p, round(mean + std * -1.6448536269514729::DOUBLE, 6) AS normal_var_95, round(mean + std * -2.3263478740408408::DOUBLE, 6) AS normal_var_99, k > 1 AS fat_tailed FROM g"""
)
def return_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.distribution(returns(spark, sf), "symbol"))


@query(f"WITH {RETURNS} SELECT symbol, round(CASE WHEN count(*) < 20 OR abs(quantile_cont(ret, 0.05)) <= 1e-12 THEN 1 ELSE quantile_cont(ret, 0.95) / abs(quantile_cont(ret, 0.05)) END, 6) AS tail_ratio FROM r GROUP BY symbol")
def tail_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.tail_ratio(returns(spark, sf), "symbol"))


def hurst_sql(value: str) -> tuple[str, ...]:
    """CTEs that end in hu (symbol, hurst) of a value of b."""
    return (
        f"hc AS (SELECT symbol, n, {value} AS v, count(*) OVER (PARTITION BY symbol) AS k FROM b)",
        "ht AS (SELECT a.symbol, l.lag, sqrt(stddev_samp(a.v - p.v)) AS tau FROM hc a, (SELECT unnest(range(2, 64)) AS lag) l, hc p WHERE p.symbol = a.symbol AND p.n = a.n - l.lag AND l.lag < a.k // 2 AND a.k >= 32 GROUP BY 1, 2)",
        "hf AS (SELECT symbol, count(*) AS k, regr_slope(ln(tau), ln(lag)) AS s FROM ht WHERE tau > 0 GROUP BY symbol)",
        "hu AS (SELECT s.symbol, coalesce(CASE WHEN hf.k < 4 THEN 0.5 ELSE least(greatest(hf.s * 2, 0), 1) END, 0.5) AS hurst FROM (SELECT DISTINCT symbol FROM b) s LEFT JOIN hf ON hf.symbol = s.symbol)",
    )


@query(with_bars("SELECT symbol, round(hurst, 6) AS hurst FROM hu", *hurst_sql(f"sum(close) OVER ({ORDER})")))
def hurst(spark: SparkSession, sf: str) -> DataFrame:
    b = B.event_bars(spark, sf).withColumn("v", F.sum("close").over(B.so_far()))
    return rounded(S.hurst(b, "symbol", "ts", "v"))


@query(f"WITH {BARS}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol) SELECT symbol, k * 60 AS train_start, k * 60 + 240 AS train_end, k * 60 + 250 AS test_start, k * 60 + 310 AS test_end FROM (SELECT symbol, n, unnest(range(0, 1000)) AS k FROM n) WHERE k * 60 + 310 <= n")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    n = B.event_bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.select("symbol", F.inline(S.walk_forward(F.col("n"), 240, 60, gap=10)))


@query(f"WITH {RETURNS} SELECT symbol, round(avg(ret) / stddev_samp(ret) * sqrt(8760), 6) AS statistic, CAST(2000 AS BIGINT) AS resamples FROM r GROUP BY symbol")
def bootstrap_point(spark: SparkSession, sf: str) -> DataFrame:
    """The resampled Sharpe's point estimate; its interval is in bootstrap_sharpe."""
    return rounded(S.bootstrap_sharpe(returns(spark, sf), "symbol", "ts", "ret", 8760).select("symbol", "statistic", "resamples"))


#: The same numbers as operators.stats.draw gives, of seed 7, symbol, resample i and time.
_DRAW = "('0x' || substr(md5(concat_ws(':', 7, symbol, i, epoch_us(ts))), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE"
_SHARPE = "CASE WHEN {n} >= 2 AND ({ss} - {s} * {s} / {n}) / ({n} - 1) > 1e-24 THEN {s} / {n} / sqrt(({ss} - {s} * {s} / {n}) / ({n} - 1)) * sqrt(8760) ELSE 0 END"


def _tested(least: int, beats: str) -> str:
    """From o (symbol, n, statistic) and d (symbol, d)."""
    return f"""SELECT o.symbol, CASE WHEN any_value(n) < {least} THEN 0 ELSE round(any_value(statistic), 6) END AS statistic, CASE WHEN any_value(n) < {least} THEN 0 ELSE round(quantile_cont(d, 0.025), 6) END AS lower,
  CASE WHEN any_value(n) < {least} THEN 0 ELSE round(quantile_cont(d, 0.975), 6) END AS upper, CASE WHEN any_value(n) < {least} THEN 1 ELSE round(avg(CASE WHEN {beats} THEN 1.0::DOUBLE ELSE 0 END), 6) END AS p_value,
  CASE WHEN any_value(n) < {least} THEN 0 ELSE 2000 END::BIGINT AS resamples FROM o JOIN d ON d.symbol = o.symbol GROUP BY o.symbol"""


@query(
    f"""WITH {RETURNS}, o AS (SELECT symbol, n, {_SHARPE.format(n="n", s="s", ss="ss")} AS statistic FROM (SELECT symbol, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM r GROUP BY symbol)),
e AS (SELECT symbol, i, ret AS x, {" + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in S.poisson_cuts())} AS t FROM (SELECT symbol, i, ret, {_DRAW} AS u FROM r, range(2000) k(i))),
d AS (SELECT symbol, i, {_SHARPE.format(n="k", s="s", ss="ss")} AS d FROM (SELECT symbol, i, sum(t) AS k, sum(t * x) AS s, sum(t * x * x) AS ss FROM e WHERE t > 0 GROUP BY 1, 2))
{_tested(10, "d <= 0")}"""
)
def bootstrap_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.bootstrap_sharpe(returns(spark, sf), "symbol", "ts", "ret", 8760))


@query(
    f"""WITH {RETURNS}, h AS (SELECT *, CASE WHEN held > 0 AND abs(ret) > 1e-12 THEN held * ret / ret ELSE 0 END AS h, row_number() OVER ({ORDER}) AS place FROM (SELECT symbol, ts, ret, CASE WHEN lag(ret) OVER ({ORDER}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS held FROM r)),
o AS (SELECT symbol, count(*) AS n, sum(held * ret) AS statistic FROM h GROUP BY symbol),
p AS (SELECT symbol, i, h, row_number() OVER (PARTITION BY symbol, i ORDER BY u, place) AS j FROM (SELECT symbol, i, h, place, {_DRAW} AS u FROM h, range(2000) k(i))),
d AS (SELECT p.symbol, i, sum(p.h * h.ret) AS d FROM p JOIN h ON h.symbol = p.symbol AND h.place = p.j GROUP BY 1, 2)
{_tested(20, "d >= statistic")}"""
)
def permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Holding after an up bar, against the same holding at random times."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = returns(spark, sf).withColumn("held", F.coalesce((F.lag("ret").over(w) > 0).cast("double"), F.lit(0.0)))
    return rounded(S.permutation_test(r.withColumn("strategy", F.col("held") * F.col("ret")), "symbol", "ts", "strategy", "ret"))


@query()
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    d = S.distribution(returns(spark, sf), "symbol").withColumn("sharpe", F.col("mean") / F.col("std"))
    return S.deflated(d, "sharpe", "n", 12, "skew", "excess_kurtosis").select("symbol", "sharpe", "deflated")


def _density(k: int) -> str:
    return f"ln(greatest(w{k}, 1e-12)) - 0.5::DOUBLE * (ln(2 * pi() * v{k}) + (x - m{k}) * (x - m{k}) / v{k})"


def _start(k: int, rows: str) -> str:
    mean = f"avg(CASE WHEN {rows} THEN x END)"
    return f"avg(CASE WHEN {rows} THEN 1.0::DOUBLE ELSE 0 END) AS w{k}, {mean} AS m{k}, greatest(coalesce(var_pop(CASE WHEN {rows} THEN x END), 0), 1e-24) * count(CASE WHEN {rows} THEN 1 END) / greatest(count(CASE WHEN {rows} THEN 1 END) - 1, 1) AS v{k}"


def _next(k: int) -> str:
    mean = f"f{k} / greatest(s{k}, 1e-12)"
    return f"greatest(s{k}, 1e-12) / n AS w{k}, {mean} AS m{k}, greatest(g{k} / greatest(s{k}, 1e-12) - {mean} * ({mean}), 1e-24) AS v{k}"


#: The two-state fit as a recursion whose step aggregates all returns of a symbol.
REGIME = f"""x AS MATERIALIZED (SELECT symbol, ts, ret AS x FROM r WHERE ret <> 0),
q AS (SELECT symbol, quantile_cont(abs(x), 0.7) AS q FROM x GROUP BY symbol HAVING count(*) >= 30),
em(symbol, k, w0, m0, v0, w1, m1, v1, ll, gain) AS (
  SELECT symbol, 0, w0, m0, v0, w1, m1, v1, -1e300::DOUBLE, 1e300::DOUBLE FROM (SELECT x.symbol, {_start(0, "abs(x) <= q")}, {_start(1, "abs(x) > q")} FROM x JOIN q ON q.symbol = x.symbol GROUP BY x.symbol)
  UNION ALL
  SELECT symbol, k + 1, w0, m0, v0, w1, m1, v1, l, abs(l - ll) FROM (SELECT symbol, k, ll, l, {_next(0)}, {_next(1)} FROM (
    SELECT symbol, any_value(k) AS k, any_value(ll) AS ll, count(*) AS n, sum(l) AS l, sum(1 - t) AS s0, sum((1 - t) * x) AS f0, sum((1 - t) * x * x) AS g0, sum(t) AS s1, sum(t * x) AS f1, sum(t * x * x) AS g1 FROM (
      SELECT symbol, k, ll, x, greatest(a, b) + ln(1 + exp(-abs(a - b))) AS l, 1 / (1 + exp(least(greatest(a - b, -700), 700))) AS t FROM (
        SELECT e.symbol, e.k, e.ll, x.x, {_density(0)} AS a, {_density(1)} AS b FROM em e JOIN x ON x.symbol = e.symbol WHERE e.gain >= 1e-6 AND e.k < 200)) GROUP BY symbol))
),
fit AS MATERIALIZED (SELECT symbol, gain < 1e-6 AS converged, CASE WHEN v0 > v1 THEN [w1, m1, v1, w0, m0, v0] ELSE [w0, m0, v0, w1, m1, v1] END AS p FROM em QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC) = 1),
st AS MATERIALIZED (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS state FROM (SELECT symbol, ts, v0, v1, converged, 1 / (1 + exp(least(greatest(a - b, -700), 700))) AS prob FROM (
  SELECT *, {_density(0)} AS a, {_density(1)} AS b FROM (SELECT x.*, converged, p[1] AS w0, p[2] AS m0, p[3] AS v0, p[4] AS w1, p[5] AS m1, p[6] AS v1 FROM x JOIN fit ON fit.symbol = x.symbol)))),
tp AS MATERIALIZED (SELECT symbol, state, nx AS next, count(*) AS n FROM (SELECT *, lead(state) OVER ({ORDER}) AS nx FROM st) WHERE nx IS NOT NULL GROUP BY 1, 2, 3)"""
_RECURSIVE = RETURNS.replace("WITH ", "", 1)


@query(
    f"""WITH RECURSIVE {_RECURSIVE}, {REGIME}
SELECT symbol, count(*) AS n, round(avg(state), 6) AS turbulent_share, round(sqrt(any_value(v0)), 5) AS calm_std, round(sqrt(any_value(v1)), 4) AS turbulent_std, bool_and(converged) AS converged FROM st GROUP BY symbol"""
)
def em_regime(spark: SparkSession, sf: str) -> DataFrame:
    v = Q.regime_states(returns(spark, sf), "symbol", "ts")
    figures = (F.round(F.avg("state"), 6).alias("turbulent_share"), F.round(F.first("calm_std"), 5).alias("calm_std"), F.round(F.first("turbulent_std"), 4).alias("turbulent_std"))
    return v.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *figures, F.bool_and("converged").alias("converged"))


@query(f"WITH RECURSIVE {_RECURSIVE}, {REGIME} SELECT symbol, state, next, n, round(n / sum(n) OVER (PARTITION BY symbol, state), 6) AS share FROM tp")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """How often each fitted volatility state follows each."""
    return rounded(Q.transitions(Q.regime_states(returns(spark, sf), "symbol", "ts"), "symbol", "ts"))


@query(
    f"""WITH RECURSIVE {_RECURSIVE}, {REGIME}, l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
k AS (SELECT symbol, state, sum(CASE WHEN next = state THEN n ELSE 0 END) / sum(n)::DOUBLE AS stay FROM tp GROUP BY 1, 2)
SELECT l.symbol, round(prob, 4) AS prob_turbulent, CASE WHEN l.state = 1 THEN 'turbulent' ELSE 'calm' END AS label, round(coalesce(stay, 0), 6) AS persistence, round(least(sqrt(v1) / sqrt(v0), 50), 4) AS vol_ratio, sqrt(v1) / sqrt(v0) > 50 AS degenerate,
  CASE WHEN l.state = 0 THEN 1 ELSE round(greatest(0.35, 1 / greatest(1, least(sqrt(v1) / sqrt(v0), 50))), 4) END AS risk_scalar, converged FROM l LEFT JOIN k ON k.symbol = l.symbol AND k.state = l.state"""
)
def regime_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The present volatility state of each symbol, how long such states last, and the risk to take in it."""
    states = materialise(Q.regime_states(returns(spark, sf), "symbol", "ts"), "barloom/states")
    risk = Q.regime_risk(states, "symbol", "ts")
    return risk.withColumns({c: F.round(c, n) for c, n in (("prob_turbulent", 4), ("persistence", 6), ("vol_ratio", 4), ("risk_scalar", 4))})
