"""Deterministic sums and means in fixed point.

Floating-point sums depend on the order rows are added, which on a cluster changes
with partitioning and task timing: the same query can give results that differ in
the last bits from run to run (and from any other engine). Travel times carry at
most microsecond resolution, so values are summed as whole micro-units in a decimal
(19 digits a value, 29 a sum) -- exact and order independent -- and divided once at
the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000  # micro-units


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_fixed(col) -> Column:
    """Value in whole micro-units, rounded half up."""
    return F.floor(_c(col) * F.lit(float(SCALE)) + F.lit(0.5)).cast("decimal(19,0)")


def fixed_sum(col) -> Column:
    """Exact sum (double) of the non-missing values; NULL when there are none."""
    return F.sum(to_fixed(col)).cast("double") / F.lit(float(SCALE))


def mean_of_total(total: Column, n: Column) -> Column:
    """Mean from a sum of ``to_fixed`` values and a count; NULL when nothing was counted."""
    return total.cast("double") / F.lit(float(SCALE)) / F.nullif(n, F.lit(0)).cast("double")


def fixed_mean(col) -> Column:
    """Exact-sum mean of the non-missing values; NULL when there are none."""
    return fixed_sum(col) / F.count(_c(col)).cast("double")


# For SQL text: sums in decimals of six places, means of them.
def sql_fixed_sum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(38, 6))) AS DOUBLE)"


def sql_fixed_mean(expr: str) -> str:
    return f"({sql_fixed_sum(expr)} / count({expr}))"
