"""Readers for the file formats of the pipeline (schemas declared, never inferred).

* ``read_link_observations``: ';'-separated CSV with a header (extraction output).
* ``read_forecast_log`` / ``read_external_log``: headless CSV, one file per day; a
  date range selects the day files (one multi-path read, no per-day loop of jobs),
  or a ``log_date=YYYY-MM-DD`` partitioned folder is pruned by a filter.
* ``read_wide_series``: header CSV whose first column is a time index and the other
  columns are links; returned in long form ``(model, bin_ts, LinkRef, seconds)``.
* ``read_wide_blocks``: the wide CSV blocks of ``sinks.write_wide_blocks``, in long form.
* ``read_geojson_layer``: a layer of line features; what is not one is kept apart.
* ``read_delimited``: any ';' CSV with a declared schema (link dimension, points).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_delimited(spark: SparkSession, path, schema: T.StructType, sep: str = ";",
                   header: bool = True) -> DataFrame:
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("timestampNTZFormat", TS_FORMAT).csv(path))


def read_link_observations(spark: SparkSession, path, sep: str = ";") -> DataFrame:
    return read_delimited(spark, path, schemas.LINK_OBSERVATION, sep, True)


def day_paths(pattern: str, date_from: str, date_to: str) -> list[str]:
    """One path per day, both ends included; ``pattern`` uses strftime codes."""
    a, b = dt.date.fromisoformat(date_from), dt.date.fromisoformat(date_to)
    return [(a + dt.timedelta(days=i)).strftime(pattern) for i in range((b - a).days + 1)]


def _read_days(spark, pattern_or_dir, schema, date_from, date_to, sep=","):
    """Rows of the days from ``date_from`` to ``date_to``, both included; either end may be open.

    A pattern needs both ends or ``date_from`` alone (one day); a day without a file is an
    error, raised by Spark on whatever store the path is in. Of a folder, the partition
    column ``log_date`` is filtered where there is one, the time of the row otherwise.
    """
    if "%" in pattern_or_dir:
        if date_from is None:
            raise ValueError("a pattern of day files needs date_from")
        return read_delimited(spark, day_paths(pattern_or_dir, date_from, date_to or date_from), schema, sep, header=False)
    df = read_delimited(spark, pattern_or_dir, schema, sep, header=False)
    day = F.col("log_date").cast("date") if "log_date" in df.columns else F.to_date("LogTime")
    if date_from is not None:
        df = df.where(day >= F.lit(date_from).cast("date"))
    last = date_to or date_from
    return df if last is None else df.where(day <= F.lit(last).cast("date"))


def read_forecast_log(spark: SparkSession, pattern_or_dir: str, date_from: str | None = None,
                      date_to: str | None = None, sep: str = ",") -> DataFrame:
    return _read_days(spark, pattern_or_dir, schemas.FORECAST_LOG, date_from, date_to, sep)


def read_external_log(spark: SparkSession, pattern_or_dir: str, date_from: str | None = None,
                      date_to: str | None = None, sep: str = ",") -> DataFrame:
    return _read_days(spark, pattern_or_dir, schemas.EXTERNAL_LOG, date_from, date_to, sep)


def read_wide_series(spark: SparkSession, path: str, model: str, index_col: str | None = None,
                     sep: str = ",") -> DataFrame:
    """Wide CSV (time index + one column per link) to long ``(model, bin_ts, LinkRef, seconds)``.

    The header fixes the link columns; every link column is read as a double.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    idx = index_col or header[0]
    schema = T.StructType([T.StructField(idx, T.StringType())] +
                          [T.StructField(c, T.DoubleType()) for c in header if c != idx])
    wide = read_delimited(spark, path, schema, sep, True)
    long = wide.unpivot([idx], [c for c in header if c != idx], "LinkRef", "seconds")
    return long.select(F.lit(model).alias("model"),
                       F.to_timestamp_ntz(F.col(idx)).alias("bin_ts"), "LinkRef", "seconds")


def read_wide_blocks(spark: SparkSession, path: str, index: str = "bin_ts", value: str = "seconds") -> DataFrame:
    """``(index, LinkRef, value)`` of a wide output in column blocks; empty cells have no row."""
    links = spark.read.parquet(f"{path}/links")
    names = spark.read.option("header", True).csv(f"{path}/rows").columns
    columns = [c for c in names if c not in (index, "block")]
    schema = T.StructType([T.StructField(index, T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in columns]
                          + [T.StructField("block", T.LongType())])
    wide = read_delimited(spark, f"{path}/rows", schema, ",", True)
    long = wide.unpivot([index, "block"], columns, "column", value).where(F.col(value).isNotNull())
    return long.join(links, ["block", "column"]).select(index, "LinkRef", value)


FEATURE = ("struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>")
POINTS = "array<array<double>>"


def read_geojson_layer(spark: SparkSession, path: str, collection: bool = False) -> tuple[DataFrame, DataFrame]:
    """(line features, rejected rows) of a GeoJSON layer.

    One feature a line, or (``collection``) FeatureCollection documents, one a file. Features:
    ``properties`` (map of text) and ``parts`` (lines of points x, y). A row that is no JSON, no
    feature, of another geometry, or that has a point of fewer than two numbers or a line of
    fewer than two points, is rejected: ``(row, reason)``.
    """
    if collection:
        text = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", "struct<type:string,features:array<string>>")
        text = text.select(F.explode(F.coalesce(listed["features"], F.array("value"))).alias("row"))
    else:
        text = spark.read.text(path).select(F.col("value").alias("row"))
    read = text.withColumn("f", F.from_json("row", FEATURE))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(raw, POINTS))).when(
        kind == "MultiLineString", F.from_json(raw, f"array<{POINTS}>"))
    read = read.withColumn("lines", lines)
    whole = F.forall("lines", lambda line: (F.size(line) >= 2) & F.forall(
        line, lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull()))
    reason = (F.when(F.col("f").isNull() | F.col("f.type").isNull(), "not a feature").when(F.col("f.type") != "Feature", "not a feature")
              .when(kind.isNull(), "no geometry").when(~kind.isin("LineString", "MultiLineString"), "not a line")
              .when(~F.coalesce(whole & (F.size("lines") > 0), F.lit(False)), "malformed coordinates"))
    read = read.withColumn("reason", reason)
    parts = F.transform("lines", lambda line: F.transform(line, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    return (read.where(F.col("reason").isNull()).select(F.col("f.properties").alias("properties"), parts.alias("parts")),
            read.where(F.col("reason").isNotNull()).select("row", "reason"))
