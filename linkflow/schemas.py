"""Declared schemas of the travel-time data model (never inferred)."""

from pyspark.sql import types as T

# Warehouse tables of the real-time journey store.
JOURNEY = T.StructType([
    T.StructField("JourneyRef", T.LongType(), False),
    T.StructField("JourneyPatternId", T.LongType(), True),
    T.StructField("OperatingDayDate", T.DateType(), True),
    T.StructField("OperatingDayType", T.IntegerType(), True),
])

JOURNEY_POINT = T.StructType([
    T.StructField("JourneyPointRef", T.LongType(), False),
    T.StructField("JourneyRef", T.LongType(), False),
    T.StructField("SequenceNumber", T.IntegerType(), True),
    T.StructField("IsStopPoint", T.IntegerType(), True),
    T.StructField("PlannedArrivalDateTime", T.TimestampNTZType(), True),
    T.StructField("PlannedDepartureDateTime", T.TimestampNTZType(), True),
    T.StructField("ObservedArrivalDateTime", T.TimestampNTZType(), True),
    T.StructField("ObservedDepartureDateTime", T.TimestampNTZType(), True),
])

JOURNEY_PATTERN = T.StructType([
    T.StructField("JourneyPatternId", T.LongType(), False),
    T.StructField("LineDirectionCode", T.IntegerType(), True),
    T.StructField("IsCurrent", T.IntegerType(), True),
])

JOURNEY_PATTERN_SECTION = T.StructType([
    T.StructField("JourneyPatternId", T.LongType(), False),
    T.StructField("SequenceNumber", T.IntegerType(), True),
    T.StructField("LineDirectionLegacyOrder", T.IntegerType(), True),
    T.StructField("StopPointSectionFromNumber", T.StringType(), True),
    T.StructField("StopPointSectionToNumber", T.StringType(), True),
    T.StructField("StopPointSectionFromName", T.StringType(), True),
    T.StructField("StopPointSectionToName", T.StringType(), True),
    T.StructField("IsCurrent", T.IntegerType(), True),
])

# Link observations: output of the extraction, input of every later step.
LINK_OBSERVATION = T.StructType([
    T.StructField("JourneyLinkRef", T.LongType(), True),
    T.StructField("JourneyRef", T.LongType(), True),
    T.StructField("DateTime", T.TimestampNTZType(), True),
    T.StructField("LineDirectionCode", T.IntegerType(), True),
    T.StructField("LineDirectionLinkOrder", T.IntegerType(), True),
    T.StructField("LinkRef", T.StringType(), True),
    T.StructField("LinkName", T.StringType(), True),
    T.StructField("DayOfWeek", T.IntegerType(), True),
    T.StructField("LinkTravelTime", T.DoubleType(), True),
])

# Incumbent forecast log (headless CSV, one file per day).
FORECAST_LOG = T.StructType([
    T.StructField("LogTime", T.TimestampNTZType(), True),
    T.StructField("JourneyRef", T.LongType(), True),
    T.StructField("JourneyLinkRef", T.LongType(), True),
    T.StructField("VehicleRef", T.StringType(), True),
    T.StructField("LinkRef", T.StringType(), True),
    T.StructField("EstimatedDepartureDateTime", T.TimestampNTZType(), True),
    T.StructField("EstimatedArrivalDateTime", T.TimestampNTZType(), True),
    T.StructField("EstimatedLinkTravelTime", T.DoubleType(), True),
    T.StructField("EstimateAge", T.DoubleType(), True),
])

# External traffic log (headless CSV, one file per day).
EXTERNAL_LOG = T.StructType([
    T.StructField("LogTime", T.TimestampNTZType(), True),
    T.StructField("LinkRef", T.StringType(), True),
    T.StructField("Distance", T.DoubleType(), True),
    T.StructField("Duration", T.DoubleType(), True),
])

# Long form of any per-link series or forecast.
LONG_FORECAST = T.StructType([
    T.StructField("model", T.StringType(), True),
    T.StructField("bin_ts", T.TimestampNTZType(), True),
    T.StructField("LinkRef", T.StringType(), True),
    T.StructField("seconds", T.DoubleType(), True),
])

# Geometry inputs (WKT text stands in for binary geometry).
SEGMENTS = T.StructType([
    T.StructField("TripPointF", T.StringType(), True),
    T.StructField("TripPointT", T.StringType(), True),
    T.StructField("wkt", T.StringType(), True),
])

LINK_DIMENSION = T.StructType([
    T.StructField("PointLinkRef", T.StringType(), True),
    T.StructField("StopPointLinkRef", T.StringType(), True),
])
