"""Resampling irregular per-link observations into regular time bins.

Bins are left-closed, labelled by their start and aligned to midnight. Every bin
between the first and the last observation of a link exists (empty bins are
missing values). Several links are aligned on the *union* of their bin ranges.

The heavy part -- observations to bins -- is a grouped aggregation (map-side
combined, so a hot link is spread over all map tasks). Bins are written once: spine
and cells read that small table, never the observations again.

A spine is laid out from the islands of its bin ranges (``islands``): overlapping and
adjoining ranges are merged into one row each, and every bin's position along the spine
follows from them, so nothing has to be numbered by a window over a link's history.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import fixed_mean, mean_of_total, to_fixed
from ..functions.time import epoch_seconds, floor_time, freq_seconds
from ..session import materialize
from .fill import Carried, carried

POSITION = "_pos"
STARTS = 1024                  # starting bins of one merging window


def _interval(freq) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(freq_seconds(freq)))


def bin_aggregate(df: DataFrame, key: str, ts: str, value: str, freq="15min",
                  extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """``(key, bin_ts, value mean, count)`` for observed bins only."""
    binned = df.withColumn("bin_ts", floor_time(ts, freq))
    return binned.groupBy(key, "bin_ts").agg(
        fixed_mean(value).alias(value), F.count(value).alias("n"), *extra_aggs)


def link_spans(bins: DataFrame, *keys: str) -> DataFrame:
    return bins.groupBy(*keys).agg(F.min("bin_ts").alias("first_bin"), F.max("bin_ts").alias("last_bin"))


def _merged(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., first, last) ranges of bin numbers with those that overlap or adjoin made one."""
    ordered = Window.partitionBy(*by).orderBy("first")
    reached = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") > reached + 1, 1).otherwise(0)
    numbered = ranges.withColumn("_new", new).withColumn(
        "_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def islands(spans: DataFrame, freq="15min", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., first, last, before)``: the bins that some span covers, one row per run of them.

    first and last are bin numbers (epoch seconds / step), before the bins of earlier islands.
    Spans of one start are reduced to the longest; starts are merged in windows of at most
    ``STARTS`` rows first, and what those leave (a row per run) in one window per ``by``.
    """
    step = freq_seconds(freq)
    number = [F.floor(epoch_seconds(c) / step).alias(n) for c, n in (("first_bin", "first"), ("last_bin", "last"))]
    group = [*by, "_all"]
    starts = spans.select(*by, F.lit(0).alias("_all"), *number).groupBy(*group, "first").agg(F.max("last").alias("last"))
    near = _merged(starts.withColumn("_near", F.floor(F.col("first") / STARTS)), [*group, "_near"]).drop("_near")
    runs = _merged(near, group)
    earlier = Window.partitionBy(*group).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(*by, "first", "last", F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(earlier), F.lit(0)).alias("before"))


def _with_layout(rows: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with all ``islands`` (of their ``by``) as one array ``_layout``.

    The array is no longer than the row of bins that every key is laid out to.
    """
    listed = F.sort_array(F.collect_list(F.struct("first", "last", "before"))).alias("_layout")
    if by:
        return rows.join(found.groupBy(*by).agg(listed), list(by))
    return rows.withColumn("_layout", found.agg(listed).scalar())


def position_in(layout: Column, bin_ts: str, freq) -> Column:
    """Position of a covered bin along the islands of ``layout``."""
    number = F.floor(epoch_seconds(bin_ts) / freq_seconds(freq))
    island = F.element_at(F.filter(layout, lambda i: (i["first"] <= number) & (number <= i["last"])), 1)
    return island["before"] + number - island["first"]


def _bins_of(layout: Column, freq) -> Column:
    """Every bin start of the islands, in order."""
    step = freq_seconds(freq)
    numbers = F.flatten(F.transform(layout, lambda i: F.sequence(i["first"], i["last"])))
    return F.transform(numbers, lambda n: F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), n * F.lit(step)))


def union_spine(bins: DataFrame, key: str, freq="15min", keys: DataFrame | None = None,
                by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(every key x every bin of the union of the keys' bin ranges, ``bins``), both with ``POSITION``.

    ``keys``: more columns per key, kept along the spine. ``by``: columns whose values are sets
    of keys, each with a union of its own. Size: keys x bins, the dense matrix itself; only
    bins that no key's range covers are left out.
    """
    spans = link_spans(bins, *by, key)
    rows = spans.select(*by, key)
    rows = rows if keys is None else rows.join(keys, [*by, key], "left")
    found = materialize(islands(spans, freq, by), "islands")      # a row per island, read for spine and bins
    layout = F.col("_layout")
    spine = _with_layout(rows, found, by).select(*rows.columns, F.posexplode(_bins_of(layout, freq)).alias(POSITION, "bin_ts"))
    known = _with_layout(bins, found, by).withColumn(POSITION, position_in(layout, "bin_ts", freq).cast("int"))
    return spine, known.drop("_layout")


def link_spine(bins: DataFrame, key: str, freq="15min") -> tuple[DataFrame, DataFrame]:
    """(every bin from the first to the last observed bin of each key, ``bins``), both with ``POSITION``."""
    spans = link_spans(bins, key)
    spine = spans.select(key, F.posexplode(F.sequence("first_bin", "last_bin", _interval(freq))).alias(POSITION, "bin_ts"))
    number = F.floor((epoch_seconds("bin_ts") - epoch_seconds("first_bin")) / freq_seconds(freq))
    return spine, bins.join(spans, key).withColumn(POSITION, number.cast("int")).drop("first_bin", "last_bin")


def resample_mean_count(df: DataFrame, key: str = "LinkRef", ts: str = "DateTime",
                        value: str = "LinkTravelTime", freq="15min") -> DataFrame:
    """Per key, every bin of its own range: mean (missing when empty) and count (0)."""
    bins = materialize(bin_aggregate(df, key, ts, value, freq), "bins")
    spine, _ = link_spine(bins, key, freq)
    return (spine.join(bins, [key, "bin_ts"], "left")
            .select(key, "bin_ts", value, F.coalesce("n", F.lit(0)).alias("n")))


def resample_filled(df: DataFrame, key: str, ts: str, value: str, freq="15min",
                    union: bool = True, then_bfill: bool = True) -> DataFrame:
    """Per-key bin means aligned on the union spine, then interpolate -> pad -> bfill."""
    bins = materialize(bin_aggregate(df, key, ts, value, freq), "bins")
    return filled_bins(bins, key, value, freq, union, then_bfill)


def filled_bins(bins: DataFrame, key: str, value: str, freq="15min", union: bool = True,
                then_bfill: bool = True) -> DataFrame:
    """The series of already binned means: spine, interpolate (by position) -> pad -> bfill."""
    spine, known = (union_spine if union else link_spine)(bins, key, freq)
    around = carried(spine, known, [key], POSITION, [value])
    return around.select(key, "bin_ts", Carried(value, POSITION).interpolate(then_bfill).alias(value))


def multi_resolution(df: DataFrame, key: str, ts: str, value: str,
                     freqs: Sequence = ("5min", "15min", "30min"),
                     then_bfill: bool = False) -> DataFrame:
    """The same series at several bin widths, interpolated; column ``freq`` tags each.

    Sums and counts are taken once at the greatest common width and rolled up.
    """
    finest = f"{math.gcd(*[freq_seconds(f) for f in freqs])}s"
    base = df.groupBy(key, floor_time(ts, finest).alias("bin_ts")).agg(
        F.sum(to_fixed(value)).alias("_total"), F.count(value).alias("_n"))
    base = materialize(base, "finest-bins")
    out = None
    for f in freqs:
        bins = base.groupBy(key, floor_time("bin_ts", f).alias("bin_ts")).agg(
            mean_of_total(F.sum("_total"), F.sum("_n")).alias(value))
        part = filled_bins(bins, key, value, f, union=False, then_bfill=then_bfill).withColumn(
            "freq", F.lit(str(f)))
        out = part if out is None else out.unionByName(part)
    return out
