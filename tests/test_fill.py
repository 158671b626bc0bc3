"""Chunked fills and spine islands against pandas and plain sets; plans of the binned series."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkflow.operators import fill, profile, resample, series
from linkflow.sources.adapters import Tables

SF = "/root/testdata/sf0.01"


def filled(spark, spine, known, chunk):
    s = spark.createDataFrame(spine, "k string, i int, note string")
    k = spark.createDataFrame(known, "k string, i int, v double, u double")
    c = {v: fill.Carried(v, "i") for v in ("v", "u")}
    out = fill.carried(s, k, ["k"], "i", ["v", "u"], chunk).select(
        "k", "i", "note", c["v"].own().alias("own"), c["v"].pad().alias("pad"), c["v"].bfill().alias("bfill"),
        c["v"].interpolate().alias("line"), c["v"].interpolate(False).alias("line_pad"), c["u"].pad().alias("u"))
    return out.toPandas().sort_values(["k", "i"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_carried_matches_pandas(spark, chunk):
    rnd = random.Random(4)
    n = {"a": 60, "b": 33, "none": 25, "one": 40, "late": 50}
    values = {k: [rnd.uniform(0, 9) if rnd.random() < .15 and k not in ("none", "one", "late") else None for _ in range(m)] for k, m in n.items()}
    values["one"][22], values["late"][49] = 5.0, 2.5
    spine = [(k, i, f"{k}{i}") for k, m in n.items() for i in range(m)]
    known = [(k, i, v, None) for k, vs in values.items() for i, v in enumerate(vs) if v is not None or i % 9 == 0]
    got = filled(spark, spine, known, chunk)
    assert len(got) == len(spine) and got.u.isna().all()
    for k, vs in values.items():
        own, mine = pd.Series(vs, dtype=float), got[got.k == k].reset_index(drop=True)
        line = own.interpolate() if own.notna().any() else own
        for name, want in {"own": own, "pad": own.ffill(), "bfill": own.bfill(), "line": line.ffill().bfill(), "line_pad": line.ffill()}.items():
            np.testing.assert_allclose(mine[name].to_numpy(float), want.to_numpy(float), rtol=1e-12, err_msg=f"{k} {name}")
        assert list(mine.note) == [f"{k}{i}" for i in range(n[k])]


def test_one_link_of_100000_bins(spark):
    n = 100_000
    spine = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("i"))
    known = spine.where("i % 997 = 5").withColumn("v", F.col("i") * 2.0)
    around = fill.carried(spine, known, ["k"], "i", ["v"])
    plan = around._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan                       # no frame that is summed anew for each row
    rows = around.select("i", fill.Carried("v", "i").interpolate().alias("f")).toPandas()
    last = (n - 6) // 997 * 997 + 5
    want = np.clip(rows.i, 5, last) * 2.0
    assert len(rows) == n and np.allclose(rows.f, want)


def test_bounded_window_fills_run_over_the_reversed_order(spark):
    df = spark.createDataFrame([("k", i, float(i) if i % 4 == 2 else None) for i in range(12)], "k string, i int, v double")
    out = df.select("i", fill.bfill("v", ["k"], "i").alias("b"), fill.pad("v", ["k"], "i").alias("p"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    want = pd.Series([float(i) if i % 4 == 2 else None for i in range(12)])
    got = out.toPandas().sort_values("i")
    np.testing.assert_array_equal(got.b, want.bfill())
    np.testing.assert_array_equal(got.p, want.ffill())


@pytest.mark.parametrize("seed", range(4))
def test_islands_cover_what_the_spans_cover(spark, seed, monkeypatch):
    monkeypatch.setattr(resample, "STARTS", 16)
    rnd = random.Random(seed)
    spans = [(f"k{i}", a, a + rnd.choice([0, 0, 1, 5, 30])) for i in range(60) for a in [rnd.randint(0, 1500)]]
    start = pd.Timestamp("2024-01-01")
    df = spark.createDataFrame([(k, (start + pd.Timedelta(minutes=15 * a)).to_pydatetime(), (start + pd.Timedelta(minutes=15 * b)).to_pydatetime())
                                for k, a, b in spans], "k string, first_bin timestamp_ntz, last_bin timestamp_ntz")
    base = int(start.timestamp()) // 900
    covered = sorted({x for _, a, b in spans for x in range(a, b + 1)})
    rows = sorted((r["first"] - base, r["last"] - base, r.before) for r in resample.islands(df).collect())
    assert [x for a, b, _ in rows for x in range(a, b + 1)] == covered
    assert all(b + 1 < c for (_, b, _), (c, _, _) in zip(rows, rows[1:]))           # one row per island
    assert [p for _, _, p in rows] == [covered.index(a) for a, _, _ in rows]
    bins = df.select("k", F.col("first_bin").alias("bin_ts")).unionByName(df.select("k", F.col("last_bin").alias("bin_ts"))).distinct()
    spine, known = resample.union_spine(bins, "k")
    assert spine.count() == 60 * len(covered)
    one = spine.where("k = 'k7'").orderBy(resample.POSITION).collect()
    assert [int((r.bin_ts - start.to_pydatetime()).total_seconds()) // 900 for r in one] == covered
    at = {r.bin_ts: r[resample.POSITION] for r in one}
    assert all(at[r.bin_ts] == r[resample.POSITION] for r in known.collect())


def test_facts_are_shuffled_as_partial_aggregates_only(spark, monkeypatch):
    plans = []
    keep = series.materialize
    monkeypatch.setattr(series, "materialize", lambda df, name="t": plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    obs = Tables(spark, SF).obs()
    series.transform(obs, profile.fit_profile(obs))
    (plan,) = plans
    lines = plan.split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "event_type" in line]
    assert len(scans) == 1                                                    # the facts are read once
    above = next(i for i in range(scans[0], -1, -1) if "Exchange" in lines[i])
    assert any("HashAggregate" in line and "partial_sum" in line for line in lines[above:scans[0]])
