"""Headway: time to the next observation of the same link, and its daily mean.

The next observation is found without a window over a link's whole history (a busy
link could hold a large share of all rows): rows are windowed per (link, chunk)
where chunk is a fixed time period; the last row of a chunk takes the first time of
the link's next non-empty chunk, found on the small per-(link, chunk) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import fixed_mean
from ..functions.time import floor_time, time_of_day_between
from ..session import materialize
from .resample import filled_bins


def next_time(df: DataFrame, key: str = "LinkRef", ts: str = "DateTime",
              tie: str = "JourneyLinkRef", chunk="1h") -> DataFrame:
    """Adds ``next_ts``: the time of the next row of the same key in (ts, tie) order."""
    chunked = df.withColumn("_chunk", floor_time(ts, chunk))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tie)
    with_lead = chunked.withColumn("_lead", F.lead(ts).over(w))
    firsts = chunked.groupBy(key, "_chunk").agg(F.min(ts).alias("_first"))
    wc = Window.partitionBy(key).orderBy("_chunk")
    nxt = firsts.select(key, "_chunk", F.lead("_first").over(wc).alias("_next_chunk_first"))
    out = with_lead.join(nxt, [key, "_chunk"], "left")
    return out.withColumn("next_ts", F.coalesce("_lead", "_next_chunk_first")) \
              .drop("_chunk", "_lead", "_next_chunk_first")


def headway(df: DataFrame, key: str = "LinkRef", ts: str = "DateTime",
            tie: str = "JourneyLinkRef", chunk="1h") -> DataFrame:
    """Adds ``headway`` in seconds (NULL for the last observation of a link)."""
    out = next_time(df, key, ts, tie, chunk)
    return out.withColumn("headway", F.timestamp_diff("MICROSECOND", F.col(ts), F.col("next_ts"))
                          .cast("double") / F.lit(1e6)).drop("next_ts")


def mean_headway(df: DataFrame, freq="5min", tod=("06:00", "22:00"), ts: str = "DateTime",
                 series_key: str = "series") -> DataFrame:
    """Mean over ``tod`` of the interpolated ``freq`` mean headway of all links, minutes.

    The per-bin series (one for all links) is filled chunk by chunk.
    """
    h = headway(df).withColumn("bin_ts", floor_time(ts, freq))
    bins = h.groupBy("bin_ts").agg(fixed_mean("headway").alias("h")).withColumn(series_key, F.lit(1))
    filled = filled_bins(materialize(bins, "headway-bins"), series_key, "h", freq, union=False, then_bfill=False)
    return filled.where(time_of_day_between("bin_ts", *tod)).agg(
        (F.avg("h") / F.lit(60.0)).alias("mean_headway_min"))
