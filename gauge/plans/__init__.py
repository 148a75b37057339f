"""Registered queries: the engine's operators over the analogue tables, each with its SQL twin."""

from gauge.plans import catalog_queries, format_queries, measurements, raw_queries, text_queries  # noqa: F401  they register themselves
from gauge.plans.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_sql() -> dict[str, str]:
    return SQL
