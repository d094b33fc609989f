"""Registered queries by family, each module with its QUERIES and their DuckDB ORACLES."""

from . import outcomes, records, retrieval, roles, searches

FAMILIES = (retrieval, outcomes, records, roles, searches)


def queries() -> dict:
    return {k: f for m in FAMILIES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in FAMILIES for k, s in m.ORACLES.items()}
