"""Least squares, autoregression and lag regression against numpy; errors and sums that must not be silent."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkflow.functions.fixed import fixed_sum
from linkflow.operators import extract as ex
from linkflow.operators import outliers as ol
from linkflow.operators import windows as wn
from linkflow.plans import models


def series(spark, n=120, links=("a", "b")):
    rng, rows = np.random.default_rng(3), []
    for link in links:
        z = 0.0
        for t in range(n):
            z = 0.6 * z + rng.normal()
            rows.append((link, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=15 * t), float(z), 1.0, 2.0, 1))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["LinkRef", "bin_ts", "z", "mean", "scale", "weight"]))


def design(z, lags):
    return np.column_stack([np.ones(len(z) - lags)] + [z[lags - i:len(z) - i] for i in range(1, lags + 1)]), z[lags:]


def test_autoregression_with_lagged_error(spark):
    s = series(spark)
    fitted, steps = models.sar_fit(s)
    coef = fitted.toPandas().set_index("LinkRef")
    err = steps.orderBy("LinkRef", "bin_ts").toPandas()
    for link, g in s.toPandas().sort_values("bin_ts").groupby("LinkRef"):
        x, y = design(g["z"].to_numpy(), 3)
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        x2 = np.column_stack([x, np.concatenate([[0.0], e[:-1]])])
        exp = np.linalg.lstsq(x2, y, rcond=None)[0]
        got = coef.loc[link, ["intercept", "lag_1", "lag_2", "lag_3", "lag_error"]].to_numpy(float)
        np.testing.assert_allclose(got, exp, atol=1e-8)
        np.testing.assert_allclose(err[err.LinkRef == link]["error"], y - x2 @ exp, atol=1e-8)


def test_lag_regression_out_of_sample(spark):
    lags, preds = 4, 2
    train, test = wn.roll(series(spark), lags, preds), wn.roll(series(spark, 40, ("c",)), lags, preds)
    got = models.lag_regression(train, test, preds).toPandas().sort_values(["bin_ts", "horizon"])
    fit, new = train.toPandas(), test.toPandas().sort_values("bin_ts")
    one = lambda f: np.column_stack([np.ones(len(f)), np.array(f["X"].tolist())])
    for h in range(preds):
        beta = np.linalg.lstsq(one(fit), np.array(fit["Y"].tolist())[:, h], rcond=None)[0]
        mine = got[got.horizon == h + 1]
        np.testing.assert_allclose(mine["z_pred"], one(new) @ beta, atol=1e-8)
        np.testing.assert_allclose(mine["z_true"], np.array(new["Y"].tolist())[:, h])


def test_unknown_band_is_an_error(spark):
    obs = spark.createDataFrame([("a", 1, 5.0), ("z", 1, 5.0)], "LinkRef string, slot int, LinkTravelTime double")
    slots = spark.createDataFrame([("a", 1, 0.0, 9.0)], "LinkRef string, slot int, low double, upr double")
    assert ol.remove_outliers(obs.where("LinkRef = 'a'"), slots).count() == 1
    with pytest.raises(Exception, match="no band for link z"):
        ol.remove_outliers(obs, slots).collect()


def test_sums_beyond_64_bits(spark):
    rows = spark.range(20).select(F.lit(1e12).alias("v"))
    assert rows.agg(fixed_sum("v").alias("s")).first().s == 2e13


def test_link_subset(spark):
    obs = spark.createDataFrame([(1, 0, "a"), (1, 3, "b"), (2, 3, "c"), (1, 5, "d")],
                                "LineDirectionCode int, LineDirectionLinkOrder int, LinkRef string")
    pick = lambda **k: sorted(r.LinkRef for r in ex.link_subset(obs, **k).collect())
    assert pick() == ["a", "b", "c", "d"] and pick(direction=1, order_from=3, order_to=5) == ["b", "d"]
    assert pick(order_from=3, links=["c", "a"]) == ["c"]
