"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from . import q_extract, q_forecast, q_geo, q_more, q_profile, q_series, q_study  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
