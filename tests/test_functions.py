import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkflow.functions import time as tf
from linkflow.functions.metrics import error_metrics
from linkflow.functions.text import concat_null_as_empty, horizon_label, wkt_point_xy


def test_lead_time_buckets_half_open(spark):
    t0 = dt.datetime(2017, 10, 11, 8, 0)
    rows = [(t0, t0 + dt.timedelta(minutes=m) if m is not None else None)
            for m in (-1, 0, 14.99, 15, 30, 45, 90, None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(tf.lead_time_bucket("a", "b")).collect()]
    assert got == [None, "15min", "15min", "30min", "45min", "45min+", "45min+", None]


def test_time_of_day_inclusive(spark):
    d = dt.datetime(2017, 10, 12)
    rows = [(d + dt.timedelta(hours=h, minutes=m),) for h, m in ((5, 45), (6, 0), (22, 0), (22, 15))]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = [r[0] for r in df.select(tf.time_of_day_between("t", "06:00", "22:00")).collect()]
    assert got == [False, True, True, False]


def test_floor_and_slot(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23, 59, 59, 900000), 7)],
                               "t timestamp_ntz, dow int")
    r = df.select(tf.floor_time("t", "15min").alias("f"), tf.slot_of_week("dow", "t").alias("s"),
                  tf.seconds_between(F.lit(dt.datetime(2024, 1, 7, 23, 59, 58, 999000)), "t").alias("d")
                  ).first()
    assert r["f"] == dt.datetime(2024, 1, 7, 23, 45) and r["s"] == 671 and r["d"] == 1


def test_metrics_and_text(spark):
    df = spark.createDataFrame([(10.0, 8.0), (20.0, 25.0), (0.0, 1.0), (5.0, None)], "t double, p double")
    r = df.agg(*error_metrics("t", "p")).first()
    assert r["n_pairs"] == 3
    assert r["mae"] == pytest.approx((2 + 5 + 1) / 3)
    assert r["rmse"] == pytest.approx(((4 + 25 + 1) / 3) ** 0.5)
    assert r["mape"] == pytest.approx((0.2 + 0.25) / 2 * 100)    # zero truth skipped
    assert r["rmse"] >= r["mae"]
    s = spark.createDataFrame([(None, "b", 3, "POINT (1.5 -2)")], "a string, b string, h int, w string")
    r = s.select(concat_null_as_empty(F.col("a"), ":", F.col("b")).alias("c"),
                 horizon_label("h").alias("l"), wkt_point_xy("w").alias("p")).first()
    assert r["c"] == ":b" and r["l"] == "t + 3 (45 min)" and (r["p"]["x"], r["p"]["y"]) == (1.5, -2.0)


def test_local_session_without_checkpoint_folder(tmp_path):
    """A local session whose settings name no checkpoint folder gets one of its own."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("from linkflow.session import get_session, materialize\n"
            "s = get_session('local[1]', 1, extra={'spark.ui.enabled': 'false'})\n"
            "assert s.sparkContext.getConf().get('spark.checkpoint.dir', None) is None\n"
            "assert materialize(s.range(3)).count() == 3\n")
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path), PYTHONPATH=root)
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True,
                          timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
