"""Recurrences, older preparation and position folds against plain Python."""
import random

import numpy as np
import pandas as pd
import pytest

from linkflow.operators import profile as pr
from linkflow.operators import recurrence, splits
from linkflow.plans import models


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_linear_recurrence(spark, chunk):
    rnd = random.Random(1)
    factor = {"a": -0.7, "b": 0.9, "c": 0.0}
    rows = [(k, 3 * i + 100, rnd.uniform(-1, 1), f) for k, f in factor.items() for i in range(40)]
    df = spark.createDataFrame(rows + [(None, 1, 1.0, 1.0), ("a", 1, None, 0.5)], "k string, t long, x double, f double").repartition(3)
    got = {(r.k, r.t): r.y for r in recurrence.linear_recurrence(df, ["k"], "t", "x", "f", chunk=chunk).collect()}
    want, y = {}, {}
    for k, t, x, f in rows:
        y[k] = x + f * y.get(k, 0.0)
        want[k, t] = y[k]
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-12)


def test_a_growing_recurrence_does_not_fail(spark):
    df = spark.range(5000).selectExpr("'a' as k", "id as t", "1.0D as x", "9.0D as f")
    assert recurrence.linear_recurrence(df, ["k"], "t", "x", "f", chunk=64).count() == 5000


def test_errors_are_fed_back_along_train_and_test(spark):
    rng = np.random.default_rng(3)

    def series(n):
        return pd.DataFrame([(link, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=15 * t), float(z), 1)
                             for link in "ab" for t, z in enumerate(np.cumsum(rng.normal(size=n)) * .3)], columns=["LinkRef", "bin_ts", "z", "weight"])

    parts = {"train": series(150), "test": series(60)}
    frames = {k: spark.createDataFrame(v) for k, v in parts.items()}
    fitted, _ = models.sar_fit(frames["train"], bound=0.6)
    coef = fitted.toPandas().set_index("LinkRef")
    assert (coef.lag_error.abs() <= 0.6 + 1e-12).all()
    got = models.sar_recursive(fitted, frames).toPandas().sort_values(["part", "LinkRef", "bin_ts"])
    for part, whole in parts.items():
        for link, g in whole.groupby("LinkRef"):
            z, c, e, want = g.z.to_numpy(), coef.loc[link], 0.0, []
            for t in range(3, len(z)):
                e = z[t] - (c.intercept + c.lag_1 * z[t - 1] + c.lag_2 * z[t - 2] + c.lag_3 * z[t - 3] + c.lag_error * e)
                want.append(e)
            np.testing.assert_allclose(got[(got.part == part) & (got.LinkRef == link)].error, want, atol=1e-9)


def test_bounded_coefficient_leaves_the_best_of_the_others(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = 2 + x @ [1.0, 3.0] + rng.normal(size=80)
    df = spark.createDataFrame([("k", float(v), float(a), float(b)) for v, (a, b) in zip(y, x)], "k string, y double, a double, b double")
    (r,) = models.least_squares(df, "k", "y", ["a", "b"], bound=0.5).collect()
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x[:, 0]]), y - 0.5 * x[:, 1], rcond=None)[0]
    np.testing.assert_allclose(r.coef, [*want, 0.5])


def test_position_folds(spark):
    rows = spark.range(103).withColumnRenamed("id", "p")
    tagged, folds = splits.tag_position_folds(rows, "p", 103, 0.75, 0.05, 5)
    assert splits.position_folds(103) == [(77, 82), (82, 87), (87, 92), (92, 97), (97, 102)] and folds == 5
    got = {r.p: r.segment for r in tagged.collect()}
    assert got == {p: -1 if p < 77 else min((p - 77) // 5, 5) for p in range(103)}
    assert splits.tag_position_folds(rows, "p", 3)[1] == 0
    assert splits.position_folds(40, 0.95, 0.05, 5) == [(38, 40)]


def test_older_profile_against_pandas(spark):
    rnd = random.Random(2)
    start = pd.Timestamp("2024-01-01")
    rows = []
    for link in ("a", "b"):
        for i in range(3000):
            t = start + pd.Timedelta(seconds=rnd.randrange(6 * 86400))
            rows.append((link, t.to_pydatetime(), t.isoweekday(), rnd.choice([None, rnd.gauss(60, 8), 500.0]) if i % 7 == 0 else rnd.gauss(60, 8)))
    df = spark.createDataFrame(rows, "LinkRef string, DateTime timestamp_ntz, DayOfWeek int, LinkTravelTime double")
    fitted = pr.fit_link_profile(df)
    got = fitted.slots.toPandas().sort_values(["LinkRef", "slot"])
    for link, g in pd.DataFrame(rows, columns=["LinkRef", "DateTime", "dow", "v"]).dropna().groupby("LinkRef"):
        median = g.v.median()
        mad = 1.4826 * (g.v - median).abs().median()
        low, upr = max(median - 3 * mad, 0), median + 3 * mad
        kept = g[(g.v > low) & (g.v < upr)]
        slot = (kept.dow - 1) * 96 + (kept.DateTime.dt.hour * 60 + kept.DateTime.dt.minute) // 15
        mean = kept.v.groupby(slot).mean().reindex(range(slot.max() + 1)).interpolate().rolling(7, center=True).mean()
        want = mean.reindex(range(672)).ffill().bfill()
        mine = got[got.LinkRef == link]
        np.testing.assert_allclose(mine["mean"], want, rtol=1e-6)
        np.testing.assert_allclose([mine.low.iloc[0], mine.upr.iloc[0]], [low, upr])
    assert {r.scale for r in fitted.scales.collect()} == {1.0}
