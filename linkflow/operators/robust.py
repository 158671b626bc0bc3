"""Exact robust statistics per group: median, MAD, MAD bounds.

Exact medians never buffer raw rows of a group. Values are first pre-aggregated to
``(group, value) -> count`` -- a map-side-combined aggregation that spreads a hot
group over as many reducers as it has distinct values -- and the exact weighted
percentile then runs over the distinct values only (``percentile(v, 0.5, count)``,
midpoint for even counts, same as a sorted-array median). Per-group memory is the
number of distinct values of that group, not its row count. ``middle`` bounds that too:
a group of many distinct values is narrowed to the value range that holds the middle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import SCALE, to_fixed
from ..session import materialize

MAD_SCALE = 1.4826  # consistency constant of the MAD for normal data
ROOM = 200_000      # distinct values of a group that one buffer may hold
RANGES = 4096       # value ranges that a larger group is cut into


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys..., value, n)`` over non-null values."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))


def widest(counted: DataFrame, keys: Sequence[str]) -> int:
    """Rows (distinct values) of the group that has most."""
    return counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def middle(counted: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame:
    """``(keys..., n, median)`` of a ``(keys..., value, _n)`` table of finite values.

    No group has more than ``most`` values. Up to ``ROOM`` each group is sorted in one buffer;
    beyond it (the table must then be a written one) groups are cut into ``RANGES`` value
    ranges, whose counts name the range with the middle; that range is cut again until it
    fits. The two middle positions are looked for apart, so every cut gets narrower.
    """
    keys, v = list(keys), F.col(value)
    if most <= ROOM:
        return counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.percentile(value, 0.5, F.col("_n")).alias("median"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("n"))
    n = F.col("n")
    ranks = totals.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.floor((n - 1) / 2).alias("_rank")),
                                                   F.struct(F.lit(1).alias("_side"), F.floor(n / 2).alias("_rank")))).alias("_r"))
    each = [*keys, "_side"]
    ranks = materialize(ranks.select(*keys, "_r.*"), "ranks")
    held = counted.join(ranks.select(*each), keys)
    while most > ROOM:
        spans = held.groupBy(*each).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
        share = F.try_divide(v - F.col("_min"), F.col("_max") - F.col("_min"))
        cut = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * RANGES), F.lit(RANGES - 1))
        counts = held.join(spans, each).groupBy(*each, cut.alias("_cut")).agg(
            F.sum("_n").alias("_c"), F.min(value).alias("_from"), F.max(value).alias("_to"))
        upto = F.sum("_c").over(Window.partitionBy(*each).orderBy("_cut"))          # at most RANGES rows each
        hit = (counts.withColumn("_upto", upto).join(ranks, each)
               .where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank"))))
        hit = materialize(hit.select(*each, "_from", "_to", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")), "range")
        ranks = hit.select(*each, "_rank")
        held = materialize(held.join(hit.drop("_rank"), each).where(v.between(F.col("_from"), F.col("_to")))
                           .select(*each, value, "_n"), "held")
        most = widest(held, each)
    upto = F.sum("_n").over(Window.partitionBy(*each).orderBy(value))
    at = held.withColumn("_upto", upto).join(ranks, each).where(F.col("_upto") > F.col("_rank"))
    sides = at.groupBy(*each).agg(F.min(value).alias("_v"))
    halves = sides.groupBy(*keys).agg(F.sum(F.col("_v") * F.lit(0.5)).alias("median"))
    return totals.select(*keys, "n").join(halves, keys)


def _centre(vc: DataFrame, keys: list[str], value: str, mad_scale: float):
    """(values with their group's median and count, medians, MADs) of value counts, written once."""
    vc = materialize(vc, "value-counts")
    most = widest(vc, keys)      # deviations are at most as many as values
    med = middle(vc, keys, value, most)
    if most > ROOM:
        med = materialize(med, "medians")
    vm = vc.join(med.select(*keys, "median"), keys)
    dev = (vm.groupBy(*keys, F.abs(F.col(value) - F.col("median")).alias("_dev"))
           .agg(F.sum("_n").alias("_n")))
    if most > ROOM:
        dev = materialize(dev, "deviations")
    mad = middle(dev, keys, "_dev", most).select(*keys, (F.col("median") * F.lit(mad_scale)).alias("mad"))
    return vm, med, mad


def median_mad(df: DataFrame, keys: Sequence[str], value: str,
               mad_scale: float = MAD_SCALE) -> DataFrame:
    """``(keys..., n, median, mad)`` with ``mad = mad_scale * median(|x - median|)``."""
    keys = list(keys)
    _, med, mad = _centre(value_counts(df, keys, value), keys, value, mad_scale)
    return med.join(mad, keys)


def robust_cells(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0,
                 mad_scale: float = MAD_SCALE) -> DataFrame:
    """Per group: ``n, median, mad, low, upr, n_inliers, mean, var`` of the inliers (see ``counted_cells``)."""
    return counted_cells(value_counts(df, keys, value), keys, value, k, mad_scale)


def counted_cells(counted: DataFrame, keys: Sequence[str], value: str, k: float = 3.0,
                  mad_scale: float = MAD_SCALE) -> DataFrame:
    """``robust_cells`` of rows that are ``value_counts`` already, such as merged ones.

    The raw rows are read once, into the value-count table; everything else runs on
    that compressed table (joins between per-group tables are left to AQE, which
    broadcasts from measured sizes). Inliers are ``low < x < upr``; their mean is an
    exact fixed-point sum of value x count; their variance comes from moments
    shifted by the group median (numerically stable).
    """
    keys = list(keys)
    vm, med, mad = _centre(counted, keys, value, mad_scale)
    bounds = mad_bounds(med.join(mad, keys), k)
    x = F.col(value)
    inl = vm.join(bounds.select(*keys, "low", "upr"), keys).where(strictly_inside(value))
    d = x - F.col("median")
    moments = inl.groupBy(*keys).agg(
        F.sum("_n").alias("n_inliers"),
        F.sum(to_fixed(x) * F.col("_n").cast("decimal(19,0)")).alias("_fx"),
        F.sum(d * F.col("_n")).alias("_s1"),
        F.sum(d * d * F.col("_n")).alias("_s2"))
    out = bounds.join(moments, keys, "left")
    n_in = F.coalesce(F.col("n_inliers"), F.lit(0))
    return out.select(
        *keys, "n", "median", "mad", "low", "upr", n_in.alias("n_inliers"),
        (F.col("_fx").cast("double") / F.lit(float(SCALE)) / F.col("n_inliers").cast("double"))
        .alias("mean"),
        F.when(n_in > 1, (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n_inliers"))
               / (F.col("n_inliers") - 1)).alias("var"))


def mad_bounds(stats: DataFrame, k: float = 3.0, floor: float | None = None) -> DataFrame:
    """Adds ``low = median - k*mad`` (optionally floored) and ``upr = median + k*mad``."""
    low = F.col("median") - F.lit(float(k)) * F.col("mad")
    if floor is not None:
        low = F.greatest(low, F.lit(float(floor)))
    return stats.withColumn("low", low).withColumn(
        "upr", F.col("median") + F.lit(float(k)) * F.col("mad"))


def strictly_inside(value, low="low", upr="upr"):
    """``low < value < upr`` (both strict; a zero-width band keeps nothing)."""
    v = F.col(value) if isinstance(value, str) else value
    return (v > F.col(low)) & (v < F.col(upr))
