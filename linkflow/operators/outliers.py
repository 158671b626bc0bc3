"""Outlier bounds and removal.

* ``link_mad_bounds``: one MAD band per link over its whole history, lower bound
  floored at 0 (k = 4 in exploration, 3 in the oldest pipeline variant).
* ``remove_outliers``: keep observations strictly inside the (link, slot) band of a
  fitted profile; a missing travel time is never inside, so it is removed too. Every
  observation must find its band (an unknown (link, slot) is an error).
* ``outlier_report``: removed count and share.
* ``fixed_band``: keep ``lo < x < hi`` (e.g. 0 < x < 1000).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_small
from .profile import VALUE, with_time_keys
from .robust import MAD_SCALE, mad_bounds, median_mad, strictly_inside


def link_mad_bounds(obs: DataFrame, k: float = 4.0, floor: float = 0.0,
                    mad_scale: float = MAD_SCALE) -> DataFrame:
    x = obs.where(F.col(VALUE).isNotNull()).select("LinkRef", VALUE)
    return mad_bounds(median_mad(x, ["LinkRef"], VALUE, mad_scale), k, floor)


def flag_outliers(obs: DataFrame, profile_slots: DataFrame, freq="15min") -> DataFrame:
    """Adds ``low``, ``upr`` and ``inlier`` from the filled profile of (link, slot).

    A row whose (link, slot) the profile lacks fails the job.
    """
    keyed = obs if "slot" in obs.columns else with_time_keys(obs, freq)
    bands = profile_slots.select("LinkRef", "slot", "low", "upr", F.lit(True).alias("_known"))
    joined = join_small(keyed, bands, ["LinkRef", "slot"], "left")
    unknown = F.raise_error(F.concat(F.lit("no band for link "), F.coalesce(F.col("LinkRef").cast("string"), F.lit("NULL")),
                                     F.lit(" slot "), F.coalesce(F.col("slot").cast("string"), F.lit("NULL"))))
    inlier = F.when(F.col("_known").isNull(), unknown.cast("boolean")).otherwise(
        F.coalesce(strictly_inside(VALUE), F.lit(False)))
    return joined.withColumn("inlier", inlier).drop("_known")


def remove_outliers(obs: DataFrame, profile_slots: DataFrame, freq="15min") -> DataFrame:
    """Observations strictly inside their band (columns of ``obs`` plus time keys)."""
    flagged = flag_outliers(obs, profile_slots, freq)
    return flagged.where("inlier").drop("low", "upr", "inlier")


def outlier_report(obs: DataFrame, profile_slots: DataFrame, freq="15min") -> DataFrame:
    """One row: rows, removed (outside or missing), removed_missing, removed_share (%).

    Rows of equal link, slot and value share their band: they are counted first, and the
    counts looked up.
    """
    keyed = obs if "slot" in obs.columns else with_time_keys(obs, freq)
    counted = keyed.groupBy("LinkRef", "slot", VALUE).agg(F.count(F.lit(1)).alias("_rows"))
    flagged = flag_outliers(counted, profile_slots, freq)

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_rows"))), F.lit(0))

    return flagged.agg(
        rows_where(F.lit(True)).alias("rows"), rows_where(~F.col("inlier")).alias("removed"),
        rows_where(F.col(VALUE).isNull()).alias("removed_missing"),
    ).withColumn("removed_share", F.try_divide(F.col("removed") * F.lit(100.0), F.col("rows")))


def fixed_band(obs: DataFrame, lo: float = 0.0, hi: float = 1000.0, value: str = VALUE) -> DataFrame:
    return obs.where((F.col(value) > F.lit(lo)) & (F.col(value) < F.lit(hi)))
