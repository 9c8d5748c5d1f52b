"""Parts of the DuckDB statements that the queries are held against."""

from __future__ import annotations

#: Hourly bars of the events table, numbered from 1 in each symbol.
BARS = """b0 AS MATERIALIZED (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, avg(value) AS vwap
  FROM events GROUP BY 1, 2
), b AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b0
)"""

ORDER = "PARTITION BY symbol ORDER BY ts"


def w(rows: int) -> str:
    """A window of the current row and those before it."""
    return f"({ORDER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def with_bars(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([BARS, *ctes]) + "\n" + body


def smoothing(name: str, source: str, x: str, period: int, alpha: str, n: str = "n") -> str:
    """A recursive CTE (symbol, n, v): running mean up to ``period``, then v + alpha * (x - v)."""
    return f"""{name}(symbol, n, v) AS (
  SELECT symbol, {n}, CAST({x} AS DOUBLE) FROM {source} WHERE {n} = 1
  UNION ALL
  SELECT s.symbol, s.{n}, CASE WHEN s.{n} <= {period} THEN e.v + (s.{x} - e.v) / s.{n} ELSE e.v + ({alpha}) * (s.{x} - e.v) END
  FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.{n} = e.n + 1
)"""


def summing(name: str, source: str, x: str, period: int, n: str = "n") -> str:
    """A recursive CTE (symbol, n, v): running sum up to ``period``, then v - v / period + x."""
    return f"""{name}(symbol, n, v) AS (
  SELECT symbol, {n}, CAST({x} AS DOUBLE) FROM {source} WHERE {n} = 1
  UNION ALL
  SELECT s.symbol, s.{n}, CASE WHEN s.{n} <= {period} THEN e.v + s.{x} ELSE e.v - e.v / {period}.0::DOUBLE + s.{x} END
  FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.{n} = e.n + 1
)"""


TRUE_RANGE = f"""tr AS MATERIALIZED (
  SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER ({ORDER})), abs(low - lag(close) OVER ({ORDER}))), high - low) AS t FROM b
)"""


def peers(name: str, source: str) -> str:
    """CTEs of ``source`` (symbol, ts, m): name has, for each row with an m, the latest m of every symbol: cnt, k (own place), sp and mn."""
    return f"""{name}_at AS (SELECT x.symbol, x.ts, x.m AS own, p.symbol AS peer, CASE WHEN p.symbol <= x.symbol THEN x.ts ELSE x.ts - INTERVAL 1 MICROSECOND END AS upto
  FROM {source} x, (SELECT DISTINCT symbol FROM {source}) p WHERE x.m IS NOT NULL),
{name} AS (SELECT a.symbol, a.ts, a.own AS m, count(p.m) AS cnt, count(CASE WHEN p.m < a.own OR (p.m = a.own AND a.peer < a.symbol) THEN 1 END) AS k, (max(round(p.m * 1e9)) - min(round(p.m * 1e9))) / 1e9::DOUBLE AS sp, sum(CAST(round(p.m * 1e9) AS BIGINT))::DOUBLE / count(p.m) / 1e9::DOUBLE AS mn
  FROM {name}_at a ASOF JOIN {source} p ON p.symbol = a.peer AND p.ts <= a.upto GROUP BY ALL)"""
