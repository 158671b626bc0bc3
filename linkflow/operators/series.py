"""De-seasonalised, scaled multi-link series (``transform``) and its inverse.

Per link and bin (left-closed, midnight aligned):

    x = mean travel time of the bin                 (missing when none observed)
    m = mean of the profile mean looked up for each observation of the bin,
        observations with a missing travel time included
    w = number of observed travel times (weight)
    z = (x - m) / scale

The links are aligned on the union of their bin ranges. Gap policy: ``z`` pad then
0; ``m`` and ``scale`` pad then bfill; ``w`` 0. An empty bin therefore carries the
previous z and the previous bin's m. Output is long: one row per (link, bin).

Observations are summed to (link, bin, slot of the timetable day) before the profile is looked
up: all rows of such a cell look up the same mean, so its sum, count and rows stand for them
(``cell_sums``). The observations are read and partially aggregated in place; only cells are
shuffled, joined and filled (``fill.carried``, chunk by chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import mean_of_total, to_fixed
from ..session import materialize
from .fill import Carried, carried
from .joins import join_small
from .profile import VALUE, Profile, with_time_keys
from .resample import POSITION, union_spine
from .robust import strictly_inside


def cell_sums(obs: DataFrame, freq="15min", *by: str) -> DataFrame:
    """``(by..., LinkRef, bin_ts, slot, total, seen, rows)``: additive sums of the observations."""
    keyed = with_time_keys(obs, freq).select(*by, "LinkRef", "slot", F.col("DateTimeRef").alias("bin_ts"), VALUE)
    return keyed.groupBy(*by, "LinkRef", "bin_ts", "slot").agg(
        F.sum(to_fixed(VALUE)).alias("total"), F.count(VALUE).alias("seen"), F.count(F.lit(1)).alias("rows"))


def transform_cells(cells: DataFrame, profile: Profile, freq="15min", by: Sequence[str] = ()) -> DataFrame:
    """``transform`` of observations that are ``cell_sums`` already; ``by``: one series set for each profile."""
    link = [*by, "LinkRef"]
    means = profile.slots.select(*link, "slot", F.col("mean").alias("_pmean"))
    looked_up = join_small(cells, means, [*link, "slot"], "left")
    found = F.when(F.col("_pmean").isNotNull(), F.col("rows"))
    bins = looked_up.groupBy(*link, "bin_ts").agg(
        mean_of_total(F.sum("total"), F.sum("seen")).alias("x"),
        mean_of_total(F.sum(to_fixed("_pmean") * found.cast("decimal(19,0)")), F.sum(found)).alias("m"),
        F.sum("seen").alias("w"))
    scales = profile.scales.select(*link, "scale")
    away = F.col("x") - F.col("m")
    scaled = join_small(bins, scales, link, "left")
    scaled = scaled.withColumn("z", F.try_divide(away, F.col("scale"))).withColumn(
        "dev", F.when(F.col("scale").isNotNull(), away)).drop("scale")
    scaled = materialize(scaled, "series-bins")   # read by the spine, the spans and the known values
    spine, known = union_spine(scaled, "LinkRef", freq, keys=scales, by=by)
    around = carried(spine, known, link, POSITION, ["z", "dev", "m", "x", "w"])
    z, dev, m, x, w = (Carried(v, POSITION) for v in ("z", "dev", "m", "x", "w"))
    return around.select(
        *link, "bin_ts",
        F.coalesce(z.pad(), F.lit(0.0)).alias("z"),
        # the same fill on the unscaled deviation: z * scale == dev, without rounding
        F.coalesce(dev.pad(), F.lit(0.0)).alias("dev"),
        F.coalesce(m.pad(), m.bfill()).alias("mean"),
        F.col("scale"),
        F.coalesce(w.own(), F.lit(0)).alias("weight"),
        x.own().alias("x"),
    )


def transform(obs: DataFrame, profile: Profile, freq="15min", inside: bool = False) -> DataFrame:
    """``(LinkRef, bin_ts, z, dev, mean, scale, weight, x)`` on the union spine.

    ``inside``: only observations strictly inside their link's band (``profile.scales`` of
    ``fit_link_profile``) are taken, as the older preparation did.
    """
    if inside:
        obs = join_small(obs, profile.scales.select("LinkRef", "low", "upr"), "LinkRef").where(strictly_inside(VALUE)).drop("low", "upr")
    return transform_cells(cell_sums(obs, freq), profile, freq)


def inverse(series: DataFrame, z: str = "z", out: str = "seconds") -> DataFrame:
    """``z * scale + mean`` back in seconds (observed bins give back their mean).

    For the transform's own z this is computed as ``dev + mean`` (the scale cancels),
    which is exact; missing when the link has no scale. Any other z column (a
    forecast) is scaled back explicitly.
    """
    if z == "z" and "dev" in series.columns:
        return series.withColumn(out, F.when(F.col("scale").isNotNull(),
                                             F.col("dev") + F.col("mean")))
    return series.withColumn(out, F.col(z) * F.col("scale") + F.col("mean"))
