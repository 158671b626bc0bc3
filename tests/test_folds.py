"""All folds together against one fold at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkflow.operators import profile as pr
from linkflow.operators import series as se
from linkflow.operators import splits as sp
from linkflow.operators import windows as wn
from linkflow.plans import folds as fd
from linkflow.plans import models
from linkflow.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
FOLDS, LAGS, PREDS = 3, 6, 2


@pytest.fixture(scope="module")
def obs(spark):
    return Tables(spark, SF).obs().where("LinkTravelTime is not null")


@pytest.fixture(scope="module")
def state(obs):
    return fd.fold_state(obs, 0.6, 0.1, FOLDS)


def sorted_rows(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_merged_counts_fit_the_profile_of_each_fold(obs, state):
    together = state.fit()
    for fold, train, _ in sp.expanding_folds(obs, 0.6, 0.1, FOLDS):
        alone = pr.fit_profile(train)
        for name in ("slots", "scales"):
            a = sorted_rows(getattr(alone, name), "LinkRef", *(["slot"] if name == "slots" else []))
            b = sorted_rows(getattr(together, name).where(F.col("fold") == fold).drop("fold"), "LinkRef", *(["slot"] if name == "slots" else []))
            assert len(a) == len(b) > 0
            for c in a.columns:
                if a[c].dtype == float:
                    np.testing.assert_allclose(a[c], b[c], rtol=1e-12)
                else:
                    assert list(a[c]) == list(b[c])


def test_series_and_forecasts_of_each_fold(obs, state):
    profile = state.fit()
    train, test = fd.fold_windows(state, LAGS, PREDS)
    scored = sorted_rows(models.lag_regression(train, test, PREDS, fd.FOLD), "fold", "LinkRef", "bin_ts", "horizon")
    for fold, fit_rows, new_rows in sp.expanding_folds(obs, 0.6, 0.1, FOLDS):
        alone = pr.fit_profile(fit_rows)
        a = sorted_rows(se.transform(new_rows, alone), "LinkRef", "bin_ts")
        b = sorted_rows(state.series(profile, state.test_cells()).where(F.col("fold") == fold).drop("fold"), "LinkRef", "bin_ts")
        assert list(a.bin_ts) == list(b.bin_ts)
        np.testing.assert_allclose(a[["z", "mean", "scale", "weight"]].to_numpy(float), b[["z", "mean", "scale", "weight"]].to_numpy(float), rtol=1e-9)
        rolled = wn.roll(se.transform(fit_rows, alone), LAGS, PREDS).toPandas()
        new = wn.roll(se.transform(new_rows, alone), LAGS, PREDS).toPandas().sort_values(["LinkRef", "bin_ts"])
        x, y = (np.array(rolled[c].tolist()) for c in "XY")
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        want = np.column_stack([np.ones(len(new)), np.array(new.X.tolist())]) @ beta
        mine = scored[scored.fold == fold]
        np.testing.assert_allclose(mine.z_pred.to_numpy().reshape(-1, PREDS), want, atol=1e-6)


def test_state_is_one_scan(obs, monkeypatch):
    plans = []
    keep = fd.materialize
    monkeypatch.setattr(fd, "materialize", lambda df, name="t": plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    fd.fold_state(obs, 0.6, 0.1, FOLDS)
    assert plans[0].count("FileScan") == 1 and plans[0].count("Exchange") == 1


def test_sums_of_parts_add_up(state):
    train, _ = fd.fold_windows(state, LAGS, PREDS)
    whole = sorted_rows(models.product_sums(train.drop("fold")), "position")
    parts = models.product_sums(train, fd.FOLD).groupBy("position").agg(F.sum("total").alias("total"))
    np.testing.assert_allclose(whole.total, sorted_rows(parts, "position").total, rtol=1e-9)
    assert len(whole) == (1 + LAGS + PREDS) ** 2
