"""Adapters: driver tables -> the travel-time data model.

Each adapter exists twice: as a Spark DataFrame builder and as a DuckDB CTE body
(used by the oracle SQL). Both must produce the same rows and types.

Mapping (all rows of the source tables are used):

* ``link_observations`` <- events: one observation per event. LinkRef = event_type,
  JourneyRef = user_id, DateTime = ts, DayOfWeek = ISO weekday of ts, travel time =
  value; every 20th event id carries a missing travel time so that gaps occur.
* ``journey`` <- orders x customer: pattern = customer nation, operating day = order
  date, timetable type 1 + orderkey % 3.
* ``journey_point`` <- lineitem: one point per line, numbered per order; observed
  arrival = ship date (missing for some returned parts), departure = arrival +
  quantity minutes; line number 4 is a non-stop point.
* ``journey_pattern`` / ``journey_pattern_section`` <- nation, with as many sections each as the
  longest order has lines.
* ``forecast_log`` and ``external_log`` <- events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import iso_dow
from ..operators.joins import join_small
from ..session import materialize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver parquet table scan (columns are pruned and filters pushed by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _minutes(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n, F.lit(0))


# --------------------------------------------------------------------------- Spark


def link_dimension(events: DataFrame) -> DataFrame:
    """Distinct links with their order along the line (dense rank of the link id).

    Ranked on the distinct link list (bounded by the number of links), not on the
    observations.
    """
    links = events.select(F.lit(1).alias("LineDirectionCode"),
                          F.col("event_type").alias("LinkRef")).distinct()
    w = Window.partitionBy("LineDirectionCode").orderBy("LinkRef")
    return links.select("LinkRef", (F.dense_rank().over(w) - 1).cast("int")
                        .alias("LineDirectionLinkOrder"))


def link_observations(events: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Observation rows; with ``links`` (the link dimension) also the order along the line."""
    obs = events.select(
        F.col("event_id").alias("JourneyLinkRef"),
        F.col("user_id").alias("JourneyRef"),
        F.col("ts").alias("DateTime"),
        F.lit(1).alias("LineDirectionCode"),
        F.col("event_type").alias("LinkRef"),
        F.col("event_type").alias("LinkName"),
        iso_dow("ts").alias("DayOfWeek"),
        F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("LinkTravelTime"),
    )
    if links is None:
        return obs
    obs = join_small(obs, links, "LinkRef")
    return obs.select("JourneyLinkRef", "JourneyRef", "DateTime", "LineDirectionCode",
                      "LineDirectionLinkOrder", "LinkRef", "LinkName", "DayOfWeek",
                      "LinkTravelTime")


def journey(orders: DataFrame, customer: DataFrame) -> DataFrame:
    cust = customer.select("c_custkey", "c_nationkey")
    return (orders.join(cust, orders.o_custkey == cust.c_custkey)
            .select(F.col("o_orderkey").alias("JourneyRef"),
                    F.col("c_nationkey").cast("long").alias("JourneyPatternId"),
                    F.to_date("o_orderdate").alias("OperatingDayDate"),
                    (F.lit(1) + F.col("o_orderkey") % 3).cast("int").alias("OperatingDayType")))


def journey_point(lineitem: DataFrame) -> DataFrame:
    # Number the points of a journey. The window is keyed on the same column name
    # the extraction windows use (JourneyRef), so one shuffle serves both.
    li = lineitem.withColumnRenamed("l_orderkey", "JourneyRef")
    w = Window.partitionBy("JourneyRef").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_shipdate")
    seq = F.row_number().over(w).cast("int")
    li = li.withColumn("SequenceNumber", seq)
    missing = (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 4 == 0)
    arrival = F.when(~missing, F.col("l_shipdate"))
    return li.select(
        (F.col("JourneyRef") * 1000 + F.col("SequenceNumber")).alias("JourneyPointRef"),
        "JourneyRef",
        "SequenceNumber",
        F.when(F.col("l_linenumber") == 4, 0).otherwise(1).alias("IsStopPoint"),
        (F.col("l_shipdate") + _minutes(F.col("SequenceNumber") * 10)).alias("PlannedArrivalDateTime"),
        (F.col("l_shipdate") + _minutes(F.col("SequenceNumber") * 10 + 1)).alias("PlannedDepartureDateTime"),
        arrival.alias("ObservedArrivalDateTime"),
        (arrival + _minutes(F.col("l_quantity").cast("int"))).alias("ObservedDepartureDateTime"),
    )


def journey_pattern(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").cast("long").alias("JourneyPatternId"),
                         F.col("n_regionkey").cast("int").alias("LineDirectionCode"),
                         F.lit(1).alias("IsCurrent"))


def journey_pattern_section(nation: DataFrame, lineitem: DataFrame) -> DataFrame:
    lines = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    longest = lines.agg(F.max("n").cast("int")).scalar()
    s = nation.select("n_nationkey", F.explode(F.sequence(F.lit(1), longest)).alias("s"))
    frm = (F.col("n_nationkey") * 100 + F.col("s") - 1).cast("string")
    to = (F.col("n_nationkey") * 100 + F.col("s")).cast("string")
    return s.select(
        F.col("n_nationkey").cast("long").alias("JourneyPatternId"),
        F.col("s").cast("int").alias("SequenceNumber"),
        (F.col("s") * 10 + F.col("n_nationkey") % 3).cast("int").alias("LineDirectionLegacyOrder"),
        frm.alias("StopPointSectionFromNumber"),
        to.alias("StopPointSectionToNumber"),
        F.when(F.col("s") > 1, F.concat(F.lit("Stop "), frm)).alias("StopPointSectionFromName"),
        F.concat(F.lit("Stop "), to).alias("StopPointSectionToName"),
        F.lit(1).alias("IsCurrent"),
    )


def forecast_log(events: DataFrame) -> DataFrame:
    dep = F.when(F.col("event_id") % 25 != 0,
                 F.col("ts") + _minutes(F.floor("value").cast("int") - 5))
    return events.select(
        F.col("ts").alias("LogTime"),
        F.col("user_id").alias("JourneyRef"),
        F.col("event_id").alias("JourneyLinkRef"),
        F.col("user_id").cast("string").alias("VehicleRef"),
        F.col("event_type").alias("LinkRef"),
        dep.alias("EstimatedDepartureDateTime"),
        (dep + _minutes(F.floor("value").cast("int"))).alias("EstimatedArrivalDateTime"),
        F.col("value").alias("EstimatedLinkTravelTime"),
        F.col("user_id").cast("double").alias("EstimateAge"),
    )


def external_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").alias("LogTime"),
                         F.col("event_type").alias("LinkRef"),
                         (F.col("user_id") * 10).cast("double").alias("Distance"),
                         F.col("value").alias("Duration"))


class Tables:
    """Lazy accessors of the adapted tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def obs(self) -> DataFrame:
        return link_observations(self.raw("events"))

    def ordered_obs(self) -> DataFrame:
        """Observations with their link order (the link dimension is written first)."""
        events = self.raw("events")
        return link_observations(events, materialize(link_dimension(events), "links"))

    def journey(self) -> DataFrame:
        return journey(self.raw("orders"), self.raw("customer"))

    def journey_point(self) -> DataFrame:
        return journey_point(self.raw("lineitem"))

    def pattern(self) -> DataFrame:
        return journey_pattern(self.raw("nation"))

    def section(self) -> DataFrame:
        return journey_pattern_section(self.raw("nation"), self.raw("lineitem"))

    def forecast_log(self) -> DataFrame:
        return forecast_log(self.raw("events"))

    def external_log(self) -> DataFrame:
        return external_log(self.raw("events"))


# -------------------------------------------------------------------------- DuckDB

# CTE bodies, in dependency order.
DUCKDB_VIEWS: dict[str, str] = {
    "obs_links": """
        SELECT LinkRef,
               CAST(dense_rank() OVER (PARTITION BY LineDirectionCode ORDER BY LinkRef) - 1 AS INTEGER)
                 AS LineDirectionLinkOrder
        FROM (SELECT DISTINCT 1 AS LineDirectionCode, event_type AS LinkRef FROM events) d""",
    "obs": """
        SELECT e.event_id AS JourneyLinkRef, e.user_id AS JourneyRef, e.ts AS DateTime,
               1 AS LineDirectionCode, l.LineDirectionLinkOrder, e.event_type AS LinkRef,
               e.event_type AS LinkName, CAST(isodow(e.ts) AS INTEGER) AS DayOfWeek,
               CASE WHEN e.event_id % 20 <> 0 THEN e.value END AS LinkTravelTime
        FROM events e JOIN obs_links l ON l.LinkRef = e.event_type""",
    "journey": """
        SELECT o.o_orderkey AS JourneyRef, CAST(c.c_nationkey AS BIGINT) AS JourneyPatternId,
               CAST(o.o_orderdate AS DATE) AS OperatingDayDate,
               CAST(1 + o.o_orderkey % 3 AS INTEGER) AS OperatingDayType
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "jp_src": """
        SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS seq,
               NOT (l_returnflag = 'R' AND l_partkey % 4 = 0) AS observed
        FROM lineitem""",
    "journey_point": """
        SELECT l_orderkey * 1000 + seq AS JourneyPointRef, l_orderkey AS JourneyRef,
               seq AS SequenceNumber, CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END AS IsStopPoint,
               l_shipdate + to_minutes(seq * 10) AS PlannedArrivalDateTime,
               l_shipdate + to_minutes(seq * 10 + 1) AS PlannedDepartureDateTime,
               CASE WHEN observed THEN l_shipdate END AS ObservedArrivalDateTime,
               CASE WHEN observed THEN l_shipdate + to_minutes(CAST(l_quantity AS INTEGER)) END
                 AS ObservedDepartureDateTime
        FROM jp_src""",
    "journey_pattern": """
        SELECT CAST(n_nationkey AS BIGINT) AS JourneyPatternId,
               CAST(n_regionkey AS INTEGER) AS LineDirectionCode, 1 AS IsCurrent
        FROM nation""",
    "journey_pattern_section": """
        SELECT CAST(n_nationkey AS BIGINT) AS JourneyPatternId, CAST(s AS INTEGER) AS SequenceNumber,
               CAST(s * 10 + n_nationkey % 3 AS INTEGER) AS LineDirectionLegacyOrder,
               CAST(n_nationkey * 100 + s - 1 AS VARCHAR) AS StopPointSectionFromNumber,
               CAST(n_nationkey * 100 + s AS VARCHAR) AS StopPointSectionToNumber,
               CASE WHEN s > 1 THEN 'Stop ' || CAST(n_nationkey * 100 + s - 1 AS VARCHAR) END
                 AS StopPointSectionFromName,
               'Stop ' || CAST(n_nationkey * 100 + s AS VARCHAR) AS StopPointSectionToName,
               1 AS IsCurrent
        FROM (SELECT n_nationkey, unnest(generate_series(1, longest)) AS s
              FROM nation, (SELECT max(seq) AS longest FROM jp_src)) numbered""",
    "forecast_log": """
        SELECT ts AS LogTime, user_id AS JourneyRef, event_id AS JourneyLinkRef,
               CAST(user_id AS VARCHAR) AS VehicleRef, event_type AS LinkRef,
               CASE WHEN event_id % 25 <> 0 THEN ts + to_minutes(CAST(floor(value) AS INTEGER) - 5) END
                 AS EstimatedDepartureDateTime,
               CASE WHEN event_id % 25 <> 0 THEN ts + to_minutes(2 * CAST(floor(value) AS INTEGER) - 5) END
                 AS EstimatedArrivalDateTime,
               value AS EstimatedLinkTravelTime, CAST(user_id AS DOUBLE) AS EstimateAge
        FROM events""",
    "external_log": """
        SELECT ts AS LogTime, event_type AS LinkRef, CAST(user_id * 10 AS DOUBLE) AS Distance,
               value AS Duration
        FROM events""",
}

_DEPS = {"obs": ["obs_links"], "journey_point": ["jp_src"], "journey_pattern_section": ["jp_src"]}


def with_views(sql: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the adapter CTEs it needs (plus ``extra`` named CTEs)."""
    order: list[str] = []
    for v in views:
        for dep in _DEPS.get(v, []) + [v]:
            if dep not in order:
                order.append(dep)
    ctes = [f"{name} AS ({DUCKDB_VIEWS[name]})" for name in order]
    ctes += [f"{name} AS ({body})" for name, body in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
