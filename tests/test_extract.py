"""Hand-made journeys for the extraction windows (FIXTURES.md section 8)."""
import datetime as dt

from pyspark.sql import functions as F

from linkflow import schemas
from linkflow.operators.extract import extract_link_travel_time

T0 = dt.datetime(2017, 10, 10, 8, 0, 0)


def ts(sec):
    return None if sec is None else T0 + dt.timedelta(seconds=sec)


def run(spark, points, day_type=1, pattern_current=1):
    journey = spark.createDataFrame([(1, 10, dt.date(2017, 10, 10), day_type)], schemas.JOURNEY)
    pattern = spark.createDataFrame([(10, 1, pattern_current)], schemas.JOURNEY_PATTERN)
    section = spark.createDataFrame(
        [(10, s, s * 10, str(100 + s - 1), str(100 + s), None if s == 2 else f"S{100 + s - 1}",
          f"S{100 + s}", 1) for s in range(1, 8)], schemas.JOURNEY_PATTERN_SECTION)
    rows = [(1000 + i, 1, i, stop, ts(i * 100), ts(i * 100 + 10), ts(arr), ts(dep))
            for i, (arr, dep, stop) in enumerate(points, start=1)]
    point = spark.createDataFrame(rows, schemas.JOURNEY_POINT)
    out = extract_link_travel_time(journey, pattern, point, section)
    return {r["JourneyLinkRef"]: r for r in out.collect()}


def test_consistent_journey_travel_times_and_boundaries(spark):
    # arrival/departure seconds; 0.9 -> 61.1 crosses 61 second boundaries
    pts = [(0, 0.9, 1), (61.1, 70, 1), (130, 140.5, 1), (200, 210, 1)]
    got = run(spark, pts)
    assert sorted(got) == [1002, 1003, 1004]                      # first stop dropped
    assert got[1002]["LinkTravelTime"] == 61.0                      # boundaries, not elapsed
    assert got[1003]["LinkTravelTime"] == 60.0
    assert got[1004]["LinkTravelTime"] == 60.0                      # 140.5 -> 200 crosses 60
    assert got[1003]["LinkRef"] == "102:103"
    assert got[1002]["LinkName"] == " - S102"                       # missing name part -> ''
    assert got[1003]["LineDirectionLinkOrder"] == 2                 # dense rank - 1
    assert got[1002]["DayOfWeek"] == 2                              # Tuesday


def test_late_departure_voids_whole_journey(spark):
    pts = [(0, 10, 1), (60, 200, 1), (150, 160, 1), (300, 310, 1)]
    got = run(spark, pts)
    assert all(r["LinkTravelTime"] is None for r in got.values())


def test_null_observation_and_non_stop_point(spark):
    pts = [(0, 10, 1), (None, None, 1), (500, 510, 0), (600, 610, 1)]
    got = run(spark, pts)
    assert sorted(got) == [1002, 1004]                              # non-stop filtered first
    assert got[1002]["LinkTravelTime"] is None                      # NULL arrival
    assert got[1004]["LinkTravelTime"] is None                      # lag of NULL departure
    assert got[1002]["DateTime"] == ts(210)                         # planned departure fallback


def test_timetable_type_overrides_day(spark):
    got = run(spark, [(0, 10, 1), (60, 70, 1)], day_type=3)
    assert got[1002]["DayOfWeek"] == 7


def test_non_current_pattern_is_dropped(spark):
    assert run(spark, [(0, 10, 1), (60, 70, 1)], pattern_current=0) == {}


def test_zero_and_negative_travel_times_voided(spark):
    got = run(spark, [(0, 10, 1), (10, 20, 1), (20, 30, 1)])
    assert got[1002]["LinkTravelTime"] is None                      # 0 s
