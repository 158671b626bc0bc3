"""Registered queries: route-link geometry.

The segment layer is drawn from ``lineitem``: a link for every pair of supplier and line
number, with two segments that meet in a middle point. By line number modulo 4 the segments
leave a gap, the second one is stored backwards, or both come in one multi-line text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo
from ..checks import expect_links, written
from ..session import scratch_table_path
from ..sources.adapters import Tables
from ..sources.readers import read_delimited, read_geojson_layer
from ..sources.sinks import write_geojson_lines, write_table_csv
from .registry import ORACLE, query


def segment_layer(spark, sf_dir):
    """(segments, link dimension); points of link (s, l) are (s, l), (s + 0.25, l + 0.5), (s + 0.5, l)."""
    pairs = Tables(spark, sf_dir).raw("lineitem").select("l_suppkey", "l_linenumber").distinct().select(
        F.col("l_suppkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"),
        F.concat_ws("-", "l_suppkey", "l_linenumber").alias("name"),
        (F.col("l_linenumber") % 4).alias("shape"))

    def point(dx, dy):
        return F.concat_ws(" ", (F.col("x") + dx).cast("string"), (F.col("y") + dy).cast("string"))

    def line(*points):
        return F.concat(F.lit("("), F.concat_ws(", ", *points), F.lit(")"))

    first = line(point(0, 0), point(0.25, 0.5))
    second = F.when(F.col("shape") == 0, line(point(0.375, 0.5), point(0.5, 0))).otherwise(
        line(point(0.25, 0.5), point(0.5, 0)))
    backwards = line(point(0.5, 0), point(0.25, 0.5))
    multi = F.concat(F.lit("MULTILINESTRING ("), second, F.lit(", "), first, F.lit(")"))
    one = F.when(F.col("shape") == 2, multi).otherwise(F.concat(F.lit("LINESTRING "), first))
    two = F.when(F.col("shape") == 1, F.concat(F.lit("LINESTRING "), backwards)).when(
        F.col("shape") != 2, F.concat(F.lit("LINESTRING "), second))
    ends = [F.concat(F.col("name"), F.lit(mark)) for mark in ("a", "m", "z")]
    segments = pairs.select(F.explode(F.array(
        F.struct(ends[0].alias("TripPointF"), ends[1].alias("TripPointT"), one.alias("wkt")),
        F.struct(ends[1].alias("TripPointF"), ends[2].alias("TripPointT"), two.alias("wkt")))).alias("s")).select("s.*")
    link_dim = pairs.select(
        F.explode(F.array(F.concat_ws(":", *ends[:2]), F.concat_ws(":", *ends[1:]))).alias("PointLinkRef"),
        F.concat_ws(":", ends[0], ends[2]).alias("StopPointLinkRef"))
    return segments, link_dim


# What the merge must give for that layer, written out from its points.
_EXPECTED = """
    WITH place AS (
        SELECT DISTINCT CAST(l_suppkey AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y,
               l_linenumber % 4 = 0 AS gap, l_suppkey || '-' || l_linenumber AS name FROM lineitem),
    drawn AS (
        SELECT name || 'a:' || name || 'z' AS LinkRef, gap, [x, y] AS p, [x + 0.25, y + 0.5] AS q,
               [x + 0.375, y + 0.5] AS q2, [x + 0.5, y] AS r FROM place)"""


@query("link_geometry_merge", _EXPECTED + """
    SELECT LinkRef, CASE WHEN gap THEN 'MultiLineString' ELSE 'LineString' END AS kind,
           CAST(2 AS BIGINT) AS n_segments, CAST(CASE WHEN gap THEN 2 ELSE 1 END AS BIGINT) AS n_parts,
           CASE WHEN gap
                THEN format('MULTILINESTRING (({} {}, {} {}), ({} {}, {} {}))', p[1], p[2], q[1], q[2], q2[1], q2[2], r[1], r[2])
                ELSE format('LINESTRING ({} {}, {} {}, {} {})', p[1], p[2], q[1], q[2], r[1], r[2]) END AS wkt
    FROM drawn""")
def q_link_geometry_merge(spark, sf_dir):
    merged = geo.merge_link_geometry(*segment_layer(spark, sf_dir))
    return merged.select("LinkRef", "kind", "n_segments", "n_parts", geo.geometry_wkt().alias("wkt"))


_MERGED_SQL = ORACLE["link_geometry_merge"]


def layer_from_file(spark, sf_dir):
    """(segments, link dimension), the segments written as a GeoJSON layer and read from it."""
    segments, link_dim = segment_layer(spark, sf_dir)
    path = scratch_table_path(spark, "layer")
    write_geojson_lines(geo.segment_features(segments.where("wkt is not null")), path)
    features, rejected = read_geojson_layer(spark, path)
    written(rejected, "layer-rejected", expect_links(0))        # a row that is no line feature fails the query
    return geo.layer_segments(features), link_dim


@query("link_geometry_from_file", _MERGED_SQL)
def q_link_geometry_from_file(spark, sf_dir):
    """Layer file in, merged links written as a table of texts and read back."""
    merged = geo.merge_link_geometry(*layer_from_file(spark, sf_dir))
    path = scratch_table_path(spark, "geometry")
    table = merged.select("LinkRef", "kind", "n_segments", "n_parts", geo.geometry_wkt().alias("wkt"))
    write_table_csv(table, path, ";")
    return read_delimited(spark, path, table.schema)


@query("link_geojson", _EXPECTED + """
    SELECT LinkRef, '{"type":"Feature","geometry":{"type":"' ||
           CASE WHEN gap
                THEN format('MultiLineString","coordinates":[[[{},{}],[{},{}]],[[{},{}],[{},{}]]]', p[1], p[2], q[1], q[2], q2[1], q2[2], r[1], r[2])
                ELSE format('LineString","coordinates":[[{},{}],[{},{}],[{},{}]]', p[1], p[2], q[1], q[2], r[1], r[2]) END
           || '},"properties":{"LinkRef":"' || LinkRef || '"}}' AS feature
    FROM drawn""")
def q_link_geojson(spark, sf_dir):
    return geo.geojson_features(geo.merge_link_geometry(*segment_layer(spark, sf_dir)))
