"""Streaming form of the per-link bin resampling.

The batch resampler's first step (observations -> per link, per 15-minute bin: mean
and count) as a Structured Streaming aggregation: event-time tumbling windows with
a watermark, so late observations within the delay are still counted and state of
closed bins is dropped. Watermarks need a ``TIMESTAMP`` column, so the wall-clock
``timestamp_ntz`` is reinterpreted in the (UTC) session zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import fixed_sum


def stream_bin_means(stream: DataFrame, key: str = "LinkRef", ts: str = "DateTime",
                     value: str = "LinkTravelTime", freq: str = "15 minutes",
                     delay: str = "30 minutes") -> DataFrame:
    """``(LinkRef, bin_ts, total, n, mean)`` per closed bin (append mode)."""
    s = stream.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", delay)
    agg = s.groupBy(key, F.window("_ets", freq).alias("w")).agg(
        fixed_sum(value).alias("total"), F.count(value).alias("n"))
    return agg.select(key, F.col("w.start").cast("timestamp_ntz").alias("bin_ts"), "total", "n",
                      (F.col("total") / F.col("n").cast("double")).alias("mean"))
