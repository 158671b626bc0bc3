"""Registry of named queries (Spark builder + optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_half_away(col, digits: int = 4):
    """``round(x * 10^d) / 10^d`` with halves away from zero, on the binary value.

    Spark's ``round`` rounds the shortest decimal text of a double (22.60965 ->
    22.6097) while many engines round the binary value (22.609649999... -> 22.6096);
    this form gives the latter, so results of averages compare equal across engines.
    """
    c = F.col(col) if isinstance(col, str) else col
    m = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(m) + F.lit(0.5)) / F.lit(m)


def r4(col, name: str | None = None):
    """Round an inexact (summed/averaged) result to 4 decimals for stable comparison."""
    c = round_half_away(col, 4)
    alias = name or (col if isinstance(col, str) else None)
    return c.alias(alias) if alias else c
