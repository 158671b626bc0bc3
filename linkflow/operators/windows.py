"""Lag / horizon windows over the regular multi-link series (``roll``).

On the bin order of each link (positions t = 0..T-1 of the union spine), the window
at t exists for ``lags <= t < T - preds`` (the last valid position is dropped too, as
in the original tensors):

    X = [z(t-lags), ..., z(t-1)]        oldest first
    Y = [z(t), ..., z(t+preds-1)]       with the matching mean, scale, weight

Windows are per link (partition = one link's bins, bounded by the time span);
arrays stay in long form, one row per (link, bin). ``explode_*`` give one row per
element for relational use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roll(series: DataFrame, lags: int, preds: int, key: str | Sequence[str] = "LinkRef",
         order: str = "bin_ts") -> DataFrame:
    """``(key..., bin_ts, t, X, Y, Y_mean, Y_scale, Y_weight)`` for valid window positions."""
    key = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*key).orderBy(order)
    past = w.rowsBetween(-lags, -1)
    ahead = w.rowsBetween(0, preds - 1)
    whole = Window.partitionBy(*key)
    # structs keep the positions aligned: collect_list would skip bare NULLs
    cell = F.struct("z", "mean", "scale", "weight")
    rolled = series.select(
        *key, order,
        (F.row_number().over(w) - 1).alias("t"),
        F.count(F.lit(1)).over(whole).alias("_n_bins"),
        F.collect_list(F.struct("z")).over(past).alias("_X"),
        F.collect_list(cell).over(ahead).alias("_Y"),
    )
    valid = rolled.where((F.col("t") >= lags) & (F.col("t") < F.col("_n_bins") - preds))
    return valid.select(
        *key, order, "t",
        F.transform("_X", lambda c: c["z"]).alias("X"),
        F.transform("_Y", lambda c: c["z"]).alias("Y"),
        F.transform("_Y", lambda c: c["mean"]).alias("Y_mean"),
        F.transform("_Y", lambda c: c["scale"]).alias("Y_scale"),
        F.transform("_Y", lambda c: c["weight"]).alias("Y_weight"),
    )


def explode_lags(rolled: DataFrame, key: str = "LinkRef") -> DataFrame:
    """One row per lag: ``lag`` = bins back (1 = previous bin), ``value`` = z."""
    n = F.size("X")
    out = rolled.select(key, "bin_ts", "t", n.alias("_n"), F.posexplode("X").alias("_i", "value"))
    return out.select(key, "bin_ts", "t", (F.col("_n") - F.col("_i")).cast("int").alias("lag"), "value")


def explode_horizons(rolled: DataFrame, key: str | Sequence[str] = "LinkRef") -> DataFrame:
    """One row per horizon h = 1..preds: z, mean, scale, weight of bin t + h - 1."""
    key = [key] if isinstance(key, str) else list(key)
    zipped = F.arrays_zip(F.col("Y").alias("z"), F.col("Y_mean").alias("mean"),
                          F.col("Y_scale").alias("scale"), F.col("Y_weight").alias("weight"))
    out = rolled.select(*key, "bin_ts", "t", F.posexplode(zipped).alias("_i", "_e"))
    return out.select(*key, "bin_ts", "t", (F.col("_i") + 1).cast("int").alias("horizon"),
                      F.col("_e.z").alias("z"), F.col("_e.mean").alias("mean"),
                      F.col("_e.scale").alias("scale"), F.col("_e.weight").alias("weight"))
