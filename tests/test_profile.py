"""Robust profile, fills, transform and windows on small hand-made series."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from linkflow import schemas
from linkflow.operators import fill, profile as pr, series as se, windows as wn
from linkflow.operators.robust import median_mad

MON = dt.datetime(2024, 1, 1)  # a Monday


def obs_df(spark, rows):
    """rows: (link, minutes after Monday 00:00, travel time or None)."""
    data = [(i, 1, MON + dt.timedelta(minutes=m), 1, 0, link, link,
             (MON + dt.timedelta(minutes=m)).isoweekday(), v)
            for i, (link, m, v) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.LINK_OBSERVATION)


def test_median_mad_exact(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 3, 100]] +
                               [("b", float(v)) for v in [1, 3]], "k string, v double")
    got = {r["k"]: r for r in median_mad(df, ["k"], "v").collect()}
    assert got["a"]["median"] == 2.0 and got["a"]["mad"] == pytest.approx(1.4826)
    assert got["b"]["median"] == 2.0 and got["b"]["mad"] == pytest.approx(1.4826)


def test_mad_zero_keeps_no_inlier_and_mean_is_interpolated(spark):
    rows = [("L", 0, 10.0), ("L", 1, 10.0), ("L", 2, 10.0),      # slot 0: MAD 0
            ("L", 30, 20.0), ("L", 31, 22.0), ("L", 32, 24.0),   # slot 2
            ("L", 60, 30.0), ("L", 61, 33.0)]                    # slot 4
    p = pr.fit_profile(obs_df(spark, rows), materialize=False)
    stats = {r["slot"]: r for r in p.stats.collect()}
    assert stats[0]["mad"] == 0 and stats[0]["n_inliers"] == 0 and stats[0]["mean"] is None
    assert stats[0]["low"] == stats[0]["upr"] == 10.0
    slots = {r["slot"]: r["mean"] for r in p.slots.collect()}
    assert len(slots) == 672
    assert slots[0] == 22.0                                      # leading gap: back-filled
    assert slots[2] == 22.0
    assert slots[3] == pytest.approx((22.0 + 31.5) / 2)          # interior: linear
    assert slots[671] == 31.5                                     # trailing gap: padded


def test_interpolate_matches_pandas(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=40)
    vals[rng.random(40) < 0.4] = np.nan
    vals[:3] = np.nan
    pdf = pd.DataFrame({"k": "x", "i": np.arange(40), "v": vals})
    df = spark.createDataFrame(pdf)
    got = (df.select("i", fill.interpolate("v", ["k"], "i").alias("f")).orderBy("i")
           .toPandas()["f"].to_numpy())
    exp = pd.Series(vals).interpolate().ffill().bfill().to_numpy()
    np.testing.assert_allclose(got, exp, rtol=1e-12)


def test_transform_fill_policy_and_inverse(spark):
    # link A: bins 0, 1, (2 empty), 3; link B starts at bin 2
    rows = [("A", 0, 10.0), ("A", 1, 12.0), ("A", 16, 14.0), ("A", 46, 18.0),
            ("B", 31, 20.0), ("B", 32, None), ("B", 47, 22.0)]
    o = obs_df(spark, rows)
    p = pr.fit_profile(o, materialize=False)
    out = se.transform(o, p).orderBy("LinkRef", "bin_ts").toPandas()
    a, b = out[out.LinkRef == "A"], out[out.LinkRef == "B"]
    assert len(a) == len(b) == 4                                  # union spine
    assert b.z.iloc[0] == 0.0 and b.weight.iloc[0] == 0           # lead-in: z 0, weight 0
    assert a.z.iloc[2] == a.z.iloc[1] and a.weight.iloc[2] == 0   # empty bin carries z
    assert a["mean"].iloc[2] == a["mean"].iloc[1]                 # and the previous bin's m
    inv = se.inverse(se.transform(o, p)).where("x is not null and scale is not null").toPandas()
    assert len(inv) == 3                                          # link B: MAD 0 everywhere, no scale
    np.testing.assert_allclose(inv.seconds, inv.x, rtol=1e-9)     # inverse(transform) = x


def test_roll_window_count_and_content(spark):
    pdf = pd.DataFrame({"LinkRef": "L", "bin_ts": pd.date_range("2024-01-01", periods=10, freq="15min"),
                        "z": np.arange(10, dtype=float), "mean": 1.0, "scale": 2.0, "weight": 1})
    rolled = wn.roll(spark.createDataFrame(pdf), lags=3, preds=2).orderBy("t").toPandas()
    assert list(rolled.t) == [3, 4, 5, 6, 7]                      # T - lags - preds windows
    assert list(rolled.X.iloc[0]) == [0.0, 1.0, 2.0]              # oldest first
    assert list(rolled.Y.iloc[0]) == [3.0, 4.0]
