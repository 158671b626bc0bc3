"""Merge of link geometry: every part kept, row order without effect, true GeoJSON types."""
import itertools
import json

from linkflow.operators import geo


def test_merge_ignores_row_order_and_keeps_parts():
    a, b, c, far = [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(3, 0), (2, 0)], [(9, 9), (8, 8)]
    results = {json.dumps(geo.merged_lines(list(p))) for p in itertools.permutations([a, b, c, far])}
    assert results == {json.dumps([[(0, 0), (1, 0), (2, 0), (3, 0)], [(9, 9), (8, 8)]])}


def test_no_merge_where_three_lines_meet_and_rings_close():
    star = [[(0, 0), (1, 1)], [(1, 1), (2, 0)], [(1, 1), (1, 5)]]
    assert len(geo.merged_lines(star)) == 3
    ring = geo.merged_lines([[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 0)]])
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) == 4
    assert geo.merged_lines([[(0, 0), (1, 0)], [(1, 0), (0, 0)]]) == [[(0, 0), (1, 0)]]   # the same segment twice


def test_wkt_kinds_through_spark(spark):
    rows = [("a", "b", "LINESTRING (0 0, 1 0)"), ("b", "c", "linestring(2 0, 1 0)"), ("c", "d", "POINT (5 5)"),
            ("d", "e", None), ("e", "f", "LINESTRING EMPTY"), ("f", "g", "MULTILINESTRING ((7 7, 8 8), (5 5, 6 6))"),
            ("g", "h", "LINESTRING (x y, 1 0)")]
    segments = spark.createDataFrame(rows, "TripPointF string, TripPointT string, wkt string")
    dim = spark.createDataFrame([(f"{f}:{t}", "none" if f in "cd" else "link") for f, t, _ in rows],
                                "PointLinkRef string, StopPointLinkRef string")
    merged = geo.merge_link_geometry(segments, dim)
    got = {r.LinkRef: r for r in merged.withColumn("wkt", geo.geometry_wkt()).collect()}
    assert got["none"].kind is None and got["none"].n_parts == 0 and got["none"].wkt is None
    assert got["link"].kind == "MultiLineString" and got["link"].n_segments == 4
    assert got["link"].wkt == "MULTILINESTRING ((0.0 0.0, 1.0 0.0, 2.0 0.0), (5.0 5.0, 6.0 6.0), (7.0 7.0, 8.0 8.0))"
    feature = {r.LinkRef: r.feature for r in geo.geojson_features(merged).collect()}
    assert feature["none"] is None and len(json.loads(feature["link"])["geometry"]["coordinates"]) == 3


def test_many_links_are_merged_in_batches(spark):
    """Links go through Python in batches, not as a group each; repeated and null links are as in the groups."""
    n = 3000
    rows = [(f"{i}a", f"{i}m", f"LINESTRING ({i} 0, {i} 1)") for i in range(n)] + [(f"{i}m", f"{i}z", f"LINESTRING ({i} 2, {i} 1)") for i in range(n)]
    rows += [("0m", "0z", "LINESTRING (0 2, 0 1)"), ("p", "q", "LINESTRING (5 5, 6 6)")]
    dim = [(f"{f}:{t}", f"{f[:-1]}") for f, t, _ in rows[:2 * n]] + [("p:q", None)]
    merged = geo.merge_link_geometry(spark.createDataFrame(rows, "TripPointF string, TripPointT string, wkt string").repartition(5),
                                     spark.createDataFrame(dim, "PointLinkRef string, StopPointLinkRef string"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {r.LinkRef: r for r in merged.withColumn("wkt", geo.geometry_wkt()).collect()}
    assert len(got) == n + 1 and got["0"].n_segments == 3 and got[None].wkt == "LINESTRING (5.0 5.0, 6.0 6.0)"
    for i in range(1, n):
        assert (got[str(i)].kind, got[str(i)].n_segments, got[str(i)].n_parts) == ("LineString", 2, 1)
        assert got[str(i)].wkt == f"LINESTRING ({i}.0 0.0, {i}.0 1.0, {i}.0 2.0)"


def test_point_features(spark):
    points = spark.createDataFrame([(7, "POINT (1.5 -2)")], "id int, Geography string")
    got = json.loads(geo.point_features(points).first().feature)
    assert got["geometry"] == {"type": "Point", "coordinates": [1.5, -2.0]} and got["properties"] == {"id": 7}
