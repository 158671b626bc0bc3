"""Link travel-time extraction from journey observations.

Rows of a journey are ordered by ``JourneyPointRef``. For each stop point:

* travel time = second boundaries from the previous point's observed departure to
  this point's observed arrival;
* the point is inconsistent when it departs after any later arrival, or arrives
  before any earlier departure (NULL comparisons and empty frames count as 0);
* a journey with any inconsistent point voids every travel time of the journey;
  non-positive travel times are voided too;
* the first stop feeds the windows but is dropped from the result.

Plan shape: journeys join their points on ``JourneyRef`` and every window partitions on
that same key, so one shuffle of the points serves the join and all windows. The rows
are written once; the link order (dense rank of the legacy order per line direction)
is ranked over the distinct (direction, legacy order) pairs of that table, at most as
many as sections, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concat_null_as_empty
from ..functions.time import operating_dow, seconds_between
from ..session import materialize
from .joins import join_small


def journey_link_rows(journey: DataFrame, pattern: DataFrame, point: DataFrame,
                      section: DataFrame, pattern_ids: Iterable[int] | None = None,
                      date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Joined and filtered journey points (the input rows of every window)."""
    j = journey
    if pattern_ids is not None:
        j = j.where(F.col("JourneyPatternId").isin(list(pattern_ids)))
    if date_from is not None:
        j = j.where(F.col("OperatingDayDate") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        j = j.where(F.col("OperatingDayDate") <= F.lit(date_to).cast("date"))
    jp = pattern.where(F.col("IsCurrent") == 1).select("JourneyPatternId", "LineDirectionCode")
    sec = section.where(F.col("IsCurrent") == 1).drop("IsCurrent")
    p = point.where(F.col("IsStopPoint") == 1)
    rows = join_small(j, jp, "JourneyPatternId")
    rows = rows.join(p, "JourneyRef")
    return join_small(rows, sec, ["JourneyPatternId", "SequenceNumber"])


def link_order(rows: DataFrame) -> DataFrame:
    """Dense rank (0-based) of the legacy order within each line direction."""
    pairs = rows.select("LineDirectionCode", "LineDirectionLegacyOrder").distinct()
    w = Window.partitionBy("LineDirectionCode").orderBy("LineDirectionLegacyOrder")
    return pairs.select("LineDirectionCode", "LineDirectionLegacyOrder",
                        (F.dense_rank().over(w) - 1).cast("int").alias("LineDirectionLinkOrder"))


def point_flags(rows: DataFrame) -> DataFrame:
    """Per-point travel time and inconsistency flag (windows over the journey)."""
    w = Window.partitionBy("JourneyRef").orderBy("JourneyPointRef")
    following = w.rowsBetween(1, Window.unboundedFollowing)
    preceding = w.rowsBetween(Window.unboundedPreceding, -1)
    arr, dep = F.col("ObservedArrivalDateTime"), F.col("ObservedDepartureDateTime")
    flag = (F.when(dep > F.min(arr).over(following), 1)
            .when(arr < F.max(dep).over(preceding), 1).otherwise(0))
    return rows.select(
        "*",
        seconds_between(F.lag(dep).over(w), arr).alias("RawTravelTime"),
        flag.alias("InconsistentObservation"),
    )


def journey_flags(flagged: DataFrame) -> DataFrame:
    """Adds ``HasInconsistentObservation`` (1 when any point of the journey is flagged)."""
    wj = Window.partitionBy("JourneyRef")
    return flagged.withColumn(
        "HasInconsistentObservation",
        F.when(F.sum("InconsistentObservation").over(wj) > 0, 1).otherwise(0))


def extract_link_travel_time(journey: DataFrame, pattern: DataFrame, point: DataFrame,
                             section: DataFrame, pattern_ids: Iterable[int] | None = None,
                             date_from: str | None = None, date_to: str | None = None,
                             order: bool = False) -> DataFrame:
    """The nine-column link observation table (see module docstring)."""
    rows = journey_link_rows(journey, pattern, point, section, pattern_ids, date_from, date_to)
    flagged = journey_flags(point_flags(rows))
    tt = F.col("RawTravelTime")
    stops = flagged.select(
        "SequenceNumber", "LineDirectionLegacyOrder",
        F.col("JourneyPointRef").alias("JourneyLinkRef"),
        "JourneyRef",
        F.coalesce("ObservedDepartureDateTime", "PlannedDepartureDateTime").alias("DateTime"),
        "LineDirectionCode",
        concat_null_as_empty(F.col("StopPointSectionFromNumber"), ":",
                             F.col("StopPointSectionToNumber")).alias("LinkRef"),
        concat_null_as_empty(F.col("StopPointSectionFromName"), " - ",
                             F.col("StopPointSectionToName")).alias("LinkName"),
        operating_dow("OperatingDayType", "PlannedArrivalDateTime").alias("DayOfWeek"),
        F.when((tt > 0) & (F.col("HasInconsistentObservation") == 0), tt)
        .cast("double").alias("LinkTravelTime"),
    )
    stops = materialize(stops, "journey-stops")
    ranks = materialize(link_order(stops), "link-order")
    out = join_small(stops.where(F.col("SequenceNumber") > 1), ranks,
                     ["LineDirectionCode", "LineDirectionLegacyOrder"])
    out = out.select("JourneyLinkRef", "JourneyRef", "DateTime", "LineDirectionCode", "LineDirectionLinkOrder",
                     "LinkRef", "LinkName", "DayOfWeek", "LinkTravelTime")
    return out.orderBy("JourneyLinkRef") if order else out


def link_subset(obs: DataFrame, direction: int | None = None, order_from: int | None = None,
                order_to: int | None = None, links: Iterable[str] | None = None) -> DataFrame:
    """Observations of one line direction, a range of link orders (both ends in) and/or named links."""
    if direction is not None:
        obs = obs.where(F.col("LineDirectionCode") == direction)
    if order_from is not None:
        obs = obs.where(F.col("LineDirectionLinkOrder") >= order_from)
    if order_to is not None:
        obs = obs.where(F.col("LineDirectionLinkOrder") <= order_to)
    return obs if links is None else obs.where(F.col("LinkRef").isin(list(links)))
