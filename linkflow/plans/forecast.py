"""Forecast series in long form ``(LinkRef, bin_ts, seconds)``.

* ``ground_truth``: transform of the evaluation observations with a profile fitted on
  them, inverted back to seconds (bin means; empty bins carry the previous value).
* ``historical_average``: the seasonal mean fitted on the training observations,
  taken through the same transform of the evaluation observations.
* ``incumbent_series``: a logged forecaster's estimates, restricted to one lead-time
  bucket, averaged per 15-minute bin of the log time, aligned on the union of the
  links' bins and filled (interpolate -> pad -> bfill).
* ``incumbent_multistep``: line totals per bin for each lead-time bucket.
* ``external_series``: an external traffic service's durations, same treatment.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import fixed_mean, fixed_sum
from ..functions.time import floor_time, lead_time_bucket, minutes_between
from ..operators import profile as pr
from ..operators import resample as rs
from ..operators import series as se
from ..session import materialize

LEAD_BUCKETS = ("15min", "30min", "45min")


def ground_truth(obs: DataFrame, freq="15min") -> DataFrame:
    series = se.transform(obs, pr.fit_profile(obs, freq), freq)
    return se.inverse(series).select("LinkRef", "bin_ts", "seconds")


def historical_average(train: DataFrame, test: DataFrame, freq="15min") -> DataFrame:
    series = se.transform(test, pr.fit_profile(train, freq), freq)
    return series.select("LinkRef", "bin_ts", F.col("mean").alias("seconds"))


def with_lead_bucket(log: DataFrame) -> DataFrame:
    """Adds ``lead_min`` (estimated departure - log time, minutes) and ``Prediction``."""
    return log.withColumn("lead_min", minutes_between("LogTime", "EstimatedDepartureDateTime")) \
              .withColumn("Prediction", lead_time_bucket("LogTime", "EstimatedDepartureDateTime"))


def incumbent_series(log: DataFrame, bucket: str = "15min", links: Iterable[str] | None = None,
                     freq="15min") -> DataFrame:
    df = with_lead_bucket(log).where(F.col("Prediction") == bucket)
    if links is not None:
        df = df.where(F.col("LinkRef").isin(list(links)))
    out = rs.resample_filled(df, "LinkRef", "LogTime", "EstimatedLinkTravelTime", freq)
    return out.select("LinkRef", "bin_ts", F.col("EstimatedLinkTravelTime").alias("seconds"))


def incumbent_multistep(log: DataFrame, buckets: Sequence[str] = LEAD_BUCKETS,
                        links: Iterable[str] | None = None, freq="15min") -> DataFrame:
    """``(Prediction, bin_ts, total_seconds)``: per bucket, the filled series summed over links."""
    df = with_lead_bucket(log).where(F.col("Prediction").isin(list(buckets)))
    if links is not None:
        df = df.where(F.col("LinkRef").isin(list(links)))
    value = "EstimatedLinkTravelTime"
    bins = df.groupBy("Prediction", "LinkRef", floor_time("LogTime", freq).alias("bin_ts")).agg(
        fixed_mean(value).alias(value))
    bins = materialize(bins, "forecast-bins")   # one pass over the log for all buckets
    out = None
    for b in buckets:
        series = rs.filled_bins(bins.where(F.col("Prediction") == b).drop("Prediction"), "LinkRef", value, freq)
        part = line_totals(series, value, minutes=False).withColumn("Prediction", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return out.select("Prediction", "bin_ts", F.col("total").alias("total_seconds"))


def external_series(log: DataFrame, freq="15min") -> DataFrame:
    out = rs.resample_filled(log, "LinkRef", "LogTime", "Duration", freq)
    return out.select("LinkRef", "bin_ts", F.col("Duration").alias("seconds"))


def line_totals(long: DataFrame, value: str = "seconds", by: Sequence[str] = ("bin_ts",),
                minutes: bool = True) -> DataFrame:
    """Sum over links per bin (exact fixed-point sum), optionally in minutes."""
    total = fixed_sum(value)
    if minutes:
        total = total / F.lit(60.0)
    return long.groupBy(*by).agg(total.alias("total"))


def lead_time_histogram(log: DataFrame, width_min: float = 1.0) -> DataFrame:
    """Counts of lead time (minutes) per bin of ``width_min``; missing departures skipped."""
    df = log.where(F.col("EstimatedDepartureDateTime").isNotNull()).withColumn(
        "lead_min", minutes_between("LogTime", "EstimatedDepartureDateTime"))
    return df.groupBy((F.floor(F.col("lead_min") / F.lit(width_min)) * F.lit(width_min))
                      .alias("lead_bin")).agg(F.count(F.lit(1)).alias("n"))
