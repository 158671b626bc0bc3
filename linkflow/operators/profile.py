"""Robust weekly seasonal profile of link travel times.

Per (link, slot of week) over non-missing travel times:

    median, mad = 1.4826 * median(|x - median|)
    low = median - k*mad, upr = median + k*mad              (k = 3)
    inlier  <=> low < x < upr (strict)
    mean  = mean of the inliers (missing when none: MAD 0 keeps nothing)

Per link: ``scale`` = sample standard deviation of all inliers of the link (not
de-seasonalised). The filled profile has every slot of the week for every link:
``mean``, ``low`` and ``upr`` are interpolated by slot, padded and back-filled
within the link (no wrap from Sunday to Monday).

Everything stays in long form ``(LinkRef, slot, ...)``; the scale is combined from
per-slot partial moments, so the rows are read once for the slot statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checks import Expectation, expect_profile, written
from ..functions.fixed import fixed_mean
from ..functions.time import SECONDS_PER_WEEK, freq_seconds, slot_of_week, slot_timestamp
from ..session import materialize as materialize_table
from .fill import bfill, interpolate, pad
from .joins import join_small
from .robust import MAD_SCALE, counted_cells, mad_bounds, median_mad, robust_cells, strictly_inside
from .smoothing import rolling_mean

VALUE = "LinkTravelTime"


def with_time_keys(obs: DataFrame, freq="15min") -> DataFrame:
    """Adds ``DateTimeRef`` (time floored to the bin) and ``slot`` (slot of the week).

    The slot comes from the ``DayOfWeek`` column (timetable day), not from the
    weekday of ``DateTime``.
    """
    from ..functions.time import floor_time
    return (obs.withColumn("DateTimeRef", floor_time("DateTime", freq))
            .withColumn("slot", slot_of_week("DayOfWeek", "DateTime", freq)))


def slot_statistics(obs: DataFrame, freq="15min", k: float = 3.0,
                    mad_scale: float = MAD_SCALE) -> DataFrame:
    """Observed (link, slot) cells: n, median, mad, low, upr, n_inliers, mean, var."""
    x = with_time_keys(obs, freq).where(F.col(VALUE).isNotNull()).select("LinkRef", "slot", VALUE)
    return robust_cells(x, ["LinkRef", "slot"], VALUE, k, mad_scale)


def link_scale(slot_stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-link sample std of the inliers, merged from per-slot (n, mean, var)."""
    key = [*by, "LinkRef"]
    s = slot_stats.where(F.col("n_inliers") > 0)
    per_link = s.groupBy(*key).agg(
        F.sum("n_inliers").alias("_n_link"),
        (F.sum(F.col("mean") * F.col("n_inliers")) / F.sum("n_inliers")).alias("_mu"))
    m2 = (s.join(per_link, key)
          .groupBy(*key, "_n_link")
          .agg((F.sum(F.coalesce(F.col("var") * (F.col("n_inliers") - 1), F.lit(0.0)))
                + F.sum(F.col("n_inliers") * (F.col("mean") - F.col("_mu")) ** 2)).alias("_m2")))
    n = F.col("_n_link")
    return m2.select(*key, n.alias("n_inliers"),
                     F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))).alias("scale"))


def fill_profile(slot_stats: DataFrame, links: DataFrame, freq="15min", by: Sequence[str] = ()) -> DataFrame:
    """Every slot of the week for every link, with mean/low/upr interpolated -> pad -> bfill."""
    n_slots = SECONDS_PER_WEEK // freq_seconds(freq)
    part = [*by, "LinkRef"]
    spine = links.select(*part, F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"))
    cells = spine.join(slot_stats.select(*part, "slot", "mean", "low", "upr"),
                       [*part, "slot"], "left")
    return cells.select(
        *part, "slot",
        slot_timestamp("slot", freq).alias("DowTimeRef"),
        interpolate("mean", part, "slot").alias("mean"),
        interpolate("low", part, "slot").alias("low"),
        interpolate("upr", part, "slot").alias("upr"),
    )


class Profile:
    """A fitted profile: filled (link, slot) table and per-link scales.

    Both are written when they are first asked for: their readers join them with facts, and
    Spark then knows their bytes and broadcasts them below its own threshold, never above.
    """

    def __init__(self, filled: DataFrame, scales: DataFrame, stats: DataFrame, freq, written: bool = True,
                 expect: Sequence[Expectation] = ()):
        self.stats, self.freq, self._expect = stats, freq, list(expect)
        self._tables = {"slots": filled, "scales": scales}
        self._unwritten = {"slots", "scales"} if written else set()

    def _table(self, name: str) -> DataFrame:
        if name in self._unwritten:
            self._unwritten.discard(name)
            self._tables[name] = written(self._tables[name], f"profile-{name}", self._expect if name == "slots" else [])
        return self._tables[name]

    @property
    def slots(self) -> DataFrame:
        return self._table("slots")

    @property
    def scales(self) -> DataFrame:
        return self._table("scales")


def fit_profile(obs: DataFrame, freq="15min", k: float = 3.0,
                mad_scale: float = MAD_SCALE, materialize: bool = True, links: int | None = None) -> Profile:
    """Fit the seasonal profile (``fit_scale`` of the original pipeline).

    The fitted cell statistics are a model: with ``materialize`` they are computed
    once and written as a table in the shared checkpoint folder (lineage cut,
    executor loss safe), so every later use -- lookups, outlier bands, size checks
    -- reads the small result (links x slots rows) instead of re-running the fit. With
    ``links`` the job that writes the filled profile fails if it has another number of links,
    or a gap.
    """
    expect = () if links is None else expect_profile(links, SECONDS_PER_WEEK // freq_seconds(freq))
    return _profile(slot_statistics(obs, freq, k, mad_scale), freq, materialize, expect=expect)


def fit_counted(counted: DataFrame, freq="15min", k: float = 3.0, mad_scale: float = MAD_SCALE,
                by: Sequence[str] = ()) -> Profile:
    """Profiles of value counts ``(by..., LinkRef, slot, VALUE, _n)``: one for every ``by``, fitted together.

    Counts add up, so they are the profile's mergeable state: the counts of several parts of
    the rows, summed, fit the same profile as the rows of all parts.
    """
    return _profile(counted_cells(counted, [*by, "LinkRef", "slot"], VALUE, k, mad_scale), freq, True, by)


def _profile(stats: DataFrame, freq, materialize: bool, by: Sequence[str] = (), expect: Sequence[Expectation] = ()) -> Profile:
    if materialize:
        stats = materialize_table(stats, "profile-cells")
    links = stats.select(*by, "LinkRef").distinct()
    return Profile(fill_profile(stats, links, freq, by), link_scale(stats, by), stats, freq, materialize, expect)


def fit_link_profile(obs: DataFrame, freq="15min", k: float = 3.0, smooth: int = 7) -> Profile:
    """The older fit: one band per link, smoothed slot means, unit scale.

    Band: median +- k MAD over the link's whole history, lower bound floored at 0. The means of
    the inliers by slot are interpolated between the link's first and last slot, averaged over
    ``smooth`` slots centred on each (missing where the window is not full), and padded, then
    back-filled over the week. ``scales`` has scale 1 and the band of every link.
    """
    x = obs.where(F.col(VALUE).isNotNull())
    bands = materialize_table(mad_bounds(median_mad(x, ["LinkRef"], VALUE), k, 0.0).select("LinkRef", "low", "upr"), "link-bands")
    inside = join_small(with_time_keys(x, freq), bands, "LinkRef").where(strictly_inside(VALUE))
    means = inside.groupBy("LinkRef", "slot").agg(fixed_mean(VALUE).alias("mean"))
    means = materialize_table(means, "link-means")
    n_slots = SECONDS_PER_WEEK // freq_seconds(freq)
    spine = bands.select("LinkRef", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"))
    cells = spine.join(means, ["LinkRef", "slot"], "left")
    last = F.max(F.when(F.col("mean").isNotNull(), F.col("slot"))).over(Window.partitionBy("LinkRef"))
    line = cells.select("LinkRef", "slot", F.when(F.col("slot") <= last, interpolate("mean", ["LinkRef"], "slot", then_bfill=False)).alias("mean"))
    smoothed = rolling_mean(line, "mean", "LinkRef", "slot", smooth, "_smooth")
    filled = smoothed.select("LinkRef", "slot", slot_timestamp("slot", freq).alias("DowTimeRef"), F.coalesce(
        pad("_smooth", ["LinkRef"], "slot"), bfill("_smooth", ["LinkRef"], "slot")).alias("mean"))
    filled = join_small(filled, bands, "LinkRef")
    return Profile(filled, bands.withColumn("scale", F.lit(1.0)), means, freq)
