"""Every query of the library by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from barloom.plans import q_bars, q_candles, q_execution, q_metrics, q_patterns, q_recursions, q_routing, q_rows, q_stats, q_stream, q_structure, q_trading, q_windows  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
