"""All queries of the core and their equivalents in SQL."""

from __future__ import annotations

from loomtrace.plans import decisions, formulation, panels, quality, replays, sources, streams, support, training, triggers

FLAGSHIP = "q01_tool_rate_by_month"
_MODULES = (decisions, formulation, sources, quality, support, triggers, replays, panels, streams, training)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
