"""Registered queries of the library's own operators."""

from . import catalogue, changes, delta, details, evaluation, graph, inventory, knowledge, ledger, lifecycle, queue, readmodels, retrieval, spans, text, vectors  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
