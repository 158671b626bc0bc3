"""Route-link geometry: key, join, dissolve, end-to-end merge, GeoJSON features.

Geometry travels as WKT text (coordinates already in the target reference system).
Parsing, gathering by link and output use built-in expressions; only the merge of the few
segments of one link is Python, over batches of links (``mapInArrow``), so a link costs
no data frame of its own.

Lines are joined wherever exactly two line ends meet; every part that is left is kept.
The result does not depend on row order: equal segments (in either direction) count once,
segments are taken in coordinate order, and a merged line runs the way most of its segments
do (on a tie, the way that sorts first). Segments that are NULL, empty or of another kind
add nothing; a link with no line has kind NULL and no parts.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_key, wkt_kind
from .joins import join_small

PARTS = "array<array<struct<x:double,y:double>>>"


def line_parts(wkt) -> Column:
    """LINESTRING or MULTILINESTRING text -> array of lines of points (NULL for other kinds)."""
    c = F.col(wkt) if isinstance(wkt, str) else wkt
    single = F.regexp_extract(c, r"(?is)^\s*LINESTRING\s*\((.*)\)\s*$", 1)
    several = F.regexp_extract(c, r"(?is)^\s*MULTILINESTRING\s*\(\s*\((.*)\)\s*\)\s*$", 1)
    body = F.when(wkt_kind(c) == "LINESTRING", single).when(wkt_kind(c) == "MULTILINESTRING", several)

    def point(text):
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(F.get(xy, 0).try_cast("double").alias("x"), F.get(xy, 1).try_cast("double").alias("y"))

    lines = F.transform(F.split(body, r"\)\s*,\s*\("), lambda line: F.transform(F.split(line, ","), point))
    return F.filter(lines, lambda line: F.forall(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def segments_with_links(segments: DataFrame, link_dim: DataFrame) -> DataFrame:
    """Segment key ``TripPointF:TripPointT`` joined to the link dimension."""
    keyed = segments.withColumn("PointLinkRef", link_key("TripPointF", "TripPointT"))
    return join_small(keyed, link_dim, "PointLinkRef")


def merged_lines(lines: list[list[tuple]]) -> list[list[tuple]]:
    """Lines joined at every point where exactly two line ends meet (see the module's docstring)."""
    lines = sorted({min(tuple(line), tuple(reversed(line))): tuple(line) for line in sorted(lines, reverse=True)}.values())
    ends = defaultdict(list)
    for i, line in enumerate(lines):
        ends[line[0]].append(i)
        ends[line[-1]].append(i)
    used: set[int] = set()

    def follow(i: int, start: tuple) -> list[tuple]:
        path, along = [start], 0
        while i is not None:
            used.add(i)
            forward = lines[i][0] == path[-1]
            along += 1 if forward else -1
            path += (lines[i] if forward else lines[i][::-1])[1:]
            meeting = ends[path[-1]]
            i = next((j for j in meeting if j not in used), None) if len(meeting) == 2 else None
        return path[::-1] if along < 0 or (along == 0 and path[::-1] < path) else path

    tips = sorted(p for p, met in ends.items() if len(met) != 2)
    found = [follow(i, p) for p in tips for i in ends[p] if i not in used]
    found += [follow(i, lines[i][0]) for i in range(len(lines)) if i not in used]   # closed rings
    return sorted(found)


def _merge_links(batches):
    """(LinkRef, kind, n_segments, n_parts, parts) of rows (LinkRef, lines), a batch of links at a time."""
    points = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for b in batches:
        lines = [[[(p["x"], p["y"]) for p in line] for line in link] for link in b.column(1).to_pylist()]
        parts = [merged_lines(link) for link in lines]
        kinds = [None if not found else "LineString" if len(found) == 1 else "MultiLineString" for found in parts]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(kinds, pa.string()), pa.array([len(link) for link in lines], pa.int64()),
            pa.array([len(found) for found in parts], pa.int64()), pa.array(parts, points)],
            names=["LinkRef", "kind", "n_segments", "n_parts", "parts"])


def merge_link_geometry(segments: DataFrame, link_dim: DataFrame) -> DataFrame:
    """Dissolve segments by stop link and merge them: (LinkRef, kind, n_segments, n_parts, parts)."""
    joined = segments_with_links(segments, link_dim).select(
        F.col("StopPointLinkRef").cast("string").alias("LinkRef"), line_parts("wkt").alias("lines"))
    links = joined.groupBy("LinkRef").agg(F.flatten(F.collect_list("lines")).alias("lines"))   # segments without a line add nothing
    return links.mapInArrow(_merge_links, f"LinkRef string, kind string, n_segments long, n_parts long, parts {PARTS}")


def geometry_wkt(parts="parts") -> Column:
    """Parts as LINESTRING or MULTILINESTRING text (NULL without parts)."""
    texts = F.transform(parts, lambda line: F.concat(F.lit("("), F.array_join(F.transform(
        line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))
    return (F.when(F.size(parts) == 1, F.concat(F.lit("LINESTRING "), texts[0]))
            .when(F.size(parts) > 1, F.concat(F.lit("MULTILINESTRING ("), F.array_join(texts, ", "), F.lit(")"))))


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        properties.alias("properties")))


def geojson_features(merged: DataFrame) -> DataFrame:
    """One GeoJSON Feature (JSON text) per link, column ``feature`` (NULL for a link without a line)."""
    lines = F.transform("parts", lambda line: F.transform(line, lambda p: F.array(p["x"], p["y"])))
    named = F.struct(F.col("LinkRef"))
    return merged.select("LinkRef", F.when(F.col("kind") == "LineString", _feature("LineString", F.get(lines, 0), named))
                         .when(F.col("kind") == "MultiLineString", _feature("MultiLineString", lines, named))
                         .alias("feature"))


def segment_features(segments: DataFrame) -> DataFrame:
    """One GeoJSON Feature per segment of a layer (``TripPointF, TripPointT, wkt``), its end points as properties."""
    lines = F.transform(line_parts("wkt"), lambda line: F.transform(line, lambda p: F.array(p["x"], p["y"])))
    ends = F.struct("TripPointF", "TripPointT")
    return segments.select(F.when(F.size(lines) == 1, _feature("LineString", F.get(lines, 0), ends)).otherwise(
        _feature("MultiLineString", lines, ends)).alias("feature"))


def layer_segments(features: DataFrame) -> DataFrame:
    """Features of a layer file (``properties``, ``parts``) as segments ``TripPointF, TripPointT, wkt``."""
    return features.select(*[F.col("properties")[c].alias(c) for c in ("TripPointF", "TripPointT")], geometry_wkt().alias("wkt"))


def point_features(points: DataFrame, wkt_col: str = "Geography") -> DataFrame:
    """Points with a WKT column to GeoJSON Point features (other columns as properties)."""
    from ..functions.text import wkt_point_xy
    xy = wkt_point_xy(wkt_col)
    props = [c for c in points.columns if c != wkt_col]
    return points.select(_feature("Point", F.array(xy["x"], xy["y"]), F.struct(*props)).alias("feature"))
