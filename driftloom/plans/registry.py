"""All queries of the corpus-evolution operators, each with its SQL."""

from __future__ import annotations

from driftloom.plans import discovery, evolution, geometry, graph, identity, joins, panel, records, rules  # noqa: F401
from driftloom.plans.core import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
