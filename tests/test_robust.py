"""Exact medians of groups too large for one buffer, narrowed by value ranges."""
import numpy as np
import pytest

from linkflow.operators import robust


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(5)
    return {"hot": r.gamma(2.0, 60.0, 4500).round(3), "odd": r.normal(50, 9, 401).round(2), "one": np.array([7.5]),
            "same": np.full(90, 3.25), "halves": np.concatenate([r.uniform(0, 1, 200), r.uniform(1e6, 1e6 + 1, 200)]),
            "ties": r.integers(0, 4, 300).astype(float)}


def _frame(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("hot", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("room,ranges", [(200_000, 4096), (10, 2), (3, 16)])
def test_median_and_mad_of_any_size(spark, groups, monkeypatch, room, ranges):
    monkeypatch.setattr(robust, "ROOM", room)
    monkeypatch.setattr(robust, "RANGES", ranges)
    got = {r["g"]: (r["n"], r["median"], r["mad"]) for r in robust.median_mad(_frame(spark, groups), ["g"], "v").collect()}
    mid = {g: np.median(vs) for g, vs in groups.items()}
    assert got == {g: (len(vs), pytest.approx(mid[g], abs=1e-9), pytest.approx(1.4826 * np.median(np.abs(vs - mid[g])), abs=1e-8))
                   for g, vs in groups.items()}


def test_cells_do_not_depend_on_the_room(spark, groups, monkeypatch):
    cells = {r["g"]: r for r in robust.robust_cells(_frame(spark, groups), ["g"], "v").collect()}
    monkeypatch.setattr(robust, "ROOM", 25)
    monkeypatch.setattr(robust, "RANGES", 4)
    assert {r["g"]: r for r in robust.robust_cells(_frame(spark, groups), ["g"], "v").collect()} == cells


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert robust.median_mad(empty, ["g"], "v").collect() == []
