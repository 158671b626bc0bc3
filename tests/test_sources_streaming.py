"""Readers (day files, wide CSV) and the streaming bin resampler, on driver-derived data."""
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from linkflow.operators.resample import bin_aggregate
from linkflow.sources import readers, sinks
from linkflow.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_day_files_date_range(spark):
    log = Tables(spark, SF).forecast_log()
    root = tempfile.mkdtemp(prefix="linkflow-days-")
    days = ["2024-01-10", "2024-01-11", "2024-01-12"]
    for d in days:
        part = log.where(F.to_date("LogTime") == F.lit(d).cast("date"))
        part.coalesce(1).write.mode("overwrite").option("header", False).csv(
            os.path.join(root, "estimated-link-travel-time_" + d.replace("-", "")))
    got = readers.read_forecast_log(spark, os.path.join(root, "estimated-link-travel-time_%Y%m%d"),
                                    "2024-01-10", "2024-01-11")
    exp = log.where(F.to_date("LogTime").between("2024-01-10", "2024-01-11"))
    assert got.count() == exp.count() > 0
    assert got.schema["LogTime"].dataType.typeName() == "timestamp_ntz"


def test_wide_round_trip(spark):
    long = Tables(spark, SF).obs().select("LinkRef", F.col("DateTime").alias("bin_ts"),
                                          F.col("LinkTravelTime").alias("seconds")) \
        .groupBy("LinkRef", "bin_ts").agg(F.max("seconds").alias("seconds"))
    path = os.path.join(tempfile.mkdtemp(prefix="linkflow-wide-"), "wide")
    sinks.write_wide_csv(long, path, [r.LinkRef for r in long.select("LinkRef").distinct().collect()])
    back = readers.read_wide_series(spark, path, "m").where("seconds is not null")
    assert back.count() == long.where("seconds is not null").count()


def test_streaming_bins_match_batch(spark):
    src_dir = tempfile.mkdtemp(prefix="linkflow-stream-")
    shutil.copy(os.path.join(SF, "events.parquet"), os.path.join(src_dir, "events.parquet"))
    from linkflow.sources.adapters import link_dimension, link_observations
    from linkflow.streaming.resample import stream_bin_means
    events = spark.read.parquet(SF + "/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(src_dir)
    obs = link_observations(stream, link_dimension(events)).where("LinkTravelTime is not null")
    q = (stream_bin_means(obs, delay="0 seconds").writeStream.outputMode("append")
         .format("memory").queryName("bins_stream").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("bins_stream")
    batch = bin_aggregate(Tables(spark, SF).obs().where("LinkTravelTime is not null"),
                          "LinkRef", "DateTime", "LinkTravelTime")
    j = got.join(batch, ["LinkRef", "bin_ts"])
    assert got.count() > 0 and j.count() == got.count()
    assert j.where(F.abs(F.col("mean") - F.col("LinkTravelTime")) > 1e-9).count() == 0


def test_missing_day_file_is_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from linkflow.sources.readers import read_external_log
    (tmp_path / "log_20240101.csv").write_text("2024-01-01 08:00:00,A,1.0,2.0\n")
    pattern = str(tmp_path / "log_%Y%m%d.csv")
    assert read_external_log(spark, pattern, "2024-01-01").count() == 1
    with pytest.raises(AnalysisException):
        read_external_log(spark, pattern, "2024-01-01", "2024-01-02").count()


def test_date_range_of_a_plain_folder(spark, tmp_path):
    from linkflow.sources.readers import read_external_log
    (tmp_path / "a.csv").write_text("2024-01-01 08:00:00,A,1.0,2.0\n2024-01-02 08:00:00,A,1.0,2.0\n2024-01-03 23:59:59,B,1.0,2.0\n")
    count = lambda a, b: read_external_log(spark, str(tmp_path), a, b).count()
    assert [count("2024-01-01", None), count("2024-01-02", "2024-01-03"), count(None, "2024-01-02"), count(None, None)] == [1, 2, 2, 3]
