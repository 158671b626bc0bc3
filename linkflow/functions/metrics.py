"""Forecast error metrics as aggregate expressions.

Errors are ``truth - forecast`` on the same unit (minutes for line totals). Pairs
with a missing side are skipped, SQL style, and the pair count is reported. Division
by a zero truth gives NULL for that pair (skipped by the average), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def error_metrics(truth, pred, prefix: str = "") -> list[Column]:
    """RMSE, MAE, MAPE (%), SMAPE (%) and the pair count for one forecast column.

    SMAPE keeps the form of the original study, ``|e| / (|a| + |f|) / 2``, which is a
    quarter of the textbook symmetric MAPE; ``smape_std`` is the textbook form
    ``2|e| / (|a| + |f|)``.
    """
    t, p = _c(truth), _c(pred)
    e = t - p
    both = t.isNotNull() & p.isNotNull()
    ae = F.when(both, F.abs(e))
    denom = F.abs(t) + F.abs(p)
    return [
        F.sqrt(F.avg(F.when(both, e * e))).alias(f"{prefix}rmse"),
        F.avg(ae).alias(f"{prefix}mae"),
        (F.avg(F.try_divide(ae, t)) * 100).alias(f"{prefix}mape"),
        (F.avg(F.try_divide(F.try_divide(ae, denom), F.lit(2.0))) * 100).alias(f"{prefix}smape"),
        (F.avg(F.try_divide(2 * ae, denom)) * 100).alias(f"{prefix}smape_std"),
        F.count(F.when(both, F.lit(1))).alias(f"{prefix}n_pairs"),
    ]
