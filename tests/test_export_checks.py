"""Exports, layer files and the assertions that a writing job checks."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from linkflow import checks
from linkflow.operators import geo
from linkflow.operators import profile as pr
from linkflow.sources import readers, sinks
from linkflow.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def forecasts(spark, fold, links=40, bins=6, shift=0.0):
    return spark.range(links * bins).select(
        F.lit("m").alias("model"), F.lit(fold).alias("fold"), F.concat(F.lit("L"), F.col("id") % links).alias("LinkRef"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.col("id") / links) * 15).cast("int"), F.lit(0))).alias("bin_ts"),
        (F.col("id") * 1.5 + shift).alias("seconds"))


def content(path):
    return {d.split("/")[-2] + "/" + d.split("/")[-1]: sorted(open(f, "rb").read() for f in glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/model=*/fold=*")}


def test_a_rerun_replaces_its_own_partitions_with_equal_files(spark, tmp_path):
    path = str(tmp_path / "export")
    sinks.write_forecast(forecasts(spark, 0), path)
    sinks.write_forecast(forecasts(spark, 1), path)
    before = content(path)
    assert set(before) == {"model=m/fold=0", "model=m/fold=1"}
    sinks.write_forecast(forecasts(spark, 0).repartition(7), path)
    assert content(path) == before
    sinks.write_forecast(forecasts(spark, 1, shift=1.0), path)
    after = content(path)
    assert after["model=m/fold=0"] == before["model=m/fold=0"] and after["model=m/fold=1"] != before["model=m/fold=1"]
    assert spark.read.parquet(path).count() == 480


def test_wide_blocks_of_10000_links(spark, tmp_path):
    path, n = str(tmp_path / "wide"), 10_000
    long = forecasts(spark, 0, links=n, bins=3)
    links = spark.range(n).select(F.concat(F.lit("L"), F.col("id")).alias("LinkRef"), ((F.col("id") * 7919) % n).alias("LineDirectionLinkOrder"))
    order = sinks.link_order(links)
    sinks.write_wide_blocks(long, path, order, width=512)
    assert len(glob.glob(f"{path}/rows/block=*")) == -(-n // 512)
    back = readers.read_wide_blocks(spark, path)
    assert back.exceptAll(long.select("bin_ts", "LinkRef", "seconds")).count() == 0 and back.count() == 3 * n
    first = spark.read.parquet(f"{path}/links").where("block = 0 and column = 'c1'").first()
    assert first.LinkRef == links.where("LineDirectionLinkOrder = 1").first().LinkRef


def test_link_order_takes_the_smallest_order(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 5), ("b", 9), ("c", 2), ("a", 7)], "LinkRef string, LineDirectionLinkOrder int")
    assert [(r.LinkRef, r.link_index) for r in sinks.link_order(rows).orderBy("link_index").collect()] == [("b", 0), ("c", 1), ("a", 2)]


def test_a_missing_link_fails_the_job_that_writes(spark):
    obs = Tables(spark, SF).obs()
    n = obs.select("LinkRef").distinct().count()
    assert pr.fit_profile(obs, links=n).slots.count() == n * 672
    with pytest.raises(checks.DataError, match=f"links: {n} instead of {n + 1}"):
        pr.fit_profile(obs, links=n + 1).slots
    with pytest.raises(checks.DataError, match="links"):
        pr.fit_profile(obs.where("LinkRef <> 'view'"), links=n).slots


def test_expectations_need_no_scan_of_their_own(spark, monkeypatch):
    written = []
    keep = checks.materialize
    monkeypatch.setattr(checks, "materialize", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    rows = spark.range(10).selectExpr("id as slot", "1.0D as mean", "0.0D as low", "2.0D as upr")
    checks.written(rows, "t", checks.expect_profile(1, 10))
    assert len(written) == 1 and "CollectMetrics" in written[0] and written[0].count("Range") == 1
    with pytest.raises(checks.DataError, match="bands_upside_down: 10 instead of 0"):
        checks.written(rows.withColumn("low", F.lit(3.0)), "t", checks.expect_profile(1, 10))
    assert checks.written(rows, "t", []).count() == 10


GOOD = [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1.5]]}, "properties": {"TripPointF": "a", "TripPointT": "b"}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[1, 1.5], [2, 2, 9]], [[5, 5], [6, 6]]]},
         "properties": {"TripPointF": "b", "TripPointT": "c", "n": 3}}]
BAD = ["{broken", json.dumps({"type": "Topology"}), json.dumps({"type": "Feature", "geometry": None, "properties": {}}),
       json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}),
       json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1], [2, 3]]}}),
       json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2]]}}),
       json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": "x"}})]


@pytest.mark.parametrize("collection", [False, True])
def test_layer_file(spark, tmp_path, collection):
    if collection:
        bad = [json.loads(b) for b in BAD[1:]]
        (tmp_path / "layer.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": GOOD + bad}, indent=1))
    else:
        (tmp_path / "layer.geojson").write_text("\n".join([json.dumps(g) for g in GOOD] + BAD))
    features, rejected = readers.read_geojson_layer(spark, str(tmp_path / "layer.geojson"), collection)
    got = {r.properties["TripPointF"]: [[(p.x, p.y) for p in line] for line in r.parts] for r in features.collect()}
    assert got == {"a": [[(0, 0), (1, 1.5)]], "b": [[(1, 1.5), (2, 2)], [(5, 5), (6, 6)]]}
    reasons = sorted(r.reason for r in rejected.collect())
    assert reasons == sorted((["not a feature"] if collection else ["not a feature"] * 2)
                             + ["no geometry", "not a line", "malformed coordinates", "malformed coordinates", "malformed coordinates"])
    texts = {r.TripPointF: r.wkt for r in geo.layer_segments(features).collect()}
    assert texts["a"] == "LINESTRING (0.0 0.0, 1.0 1.5)"


def test_layer_round_trip(spark, tmp_path):
    segments = spark.createDataFrame([("a", "b", "LINESTRING (0.5 1.0, 2.0 3.0)"), ("b", "c", "MULTILINESTRING ((1.0 1.0, 2.0 2.0), (3.0 3.0, 4.0 5.5))")],
                                     "TripPointF string, TripPointT string, wkt string")
    path = str(tmp_path / "out")
    sinks.write_geojson_lines(geo.segment_features(segments), path)
    features, rejected = readers.read_geojson_layer(spark, path)
    assert rejected.count() == 0
    assert sorted(map(tuple, geo.layer_segments(features).collect())) == sorted(map(tuple, segments.collect()))
