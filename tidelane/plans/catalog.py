"""All queries of the engine and their SQL."""

from . import queries_bars, queries_indicators, queries_metrics, queries_strategies, queries_validation  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
