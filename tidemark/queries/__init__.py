"""Registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from . import code, copies, differential, graphs, ledger, logs, more, roundtrips, scalars, sources, textrel  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
