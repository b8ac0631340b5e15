"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import aggregates, scalar, structures, vectors  # noqa: F401
from ._registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
