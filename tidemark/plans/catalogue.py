"""All registered queries and their SQL."""

from __future__ import annotations

from . import admitted, evidence, live, records, reviewed, sounds, timed  # noqa: F401  registers on import
from .base import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
