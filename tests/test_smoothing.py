"""EWM and chunked headway against brute force (pandas) on small fixtures."""
import datetime as dt

import numpy as np
import pandas as pd

from linkflow.operators.headway import headway
from linkflow.operators.smoothing import ewm


def _fixture(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    t0 = dt.datetime(2024, 1, 1)
    # irregular times across many hours (many chunks), two links, some ties in time
    mins = np.sort(rng.integers(0, 60 * 30, size=n))
    pdf = pd.DataFrame({"JourneyLinkRef": np.arange(n, dtype=np.int64),
                        "LinkRef": rng.choice(["a", "b"], size=n),
                        "DateTime": [t0 + dt.timedelta(minutes=int(m)) for m in mins],
                        "LinkTravelTime": rng.uniform(10, 300, size=n).round(2)})
    return pdf, spark.createDataFrame(pdf, "JourneyLinkRef long, LinkRef string, DateTime timestamp_ntz, LinkTravelTime double")


def test_ewm_matches_pandas(spark):
    pdf, df = _fixture(spark)
    got = ewm(df, "LinkTravelTime", span=12.0, chunk="1h").toPandas().set_index("JourneyLinkRef")["ewm"]
    for _, g in pdf.sort_values(["DateTime", "JourneyLinkRef"]).groupby("LinkRef"):
        exp = g["LinkTravelTime"].ewm(span=12, adjust=False).mean()
        np.testing.assert_allclose(got.loc[g["JourneyLinkRef"]].to_numpy(), exp.to_numpy(), rtol=1e-9)


def test_chunked_headway_matches_lead(spark):
    pdf, df = _fixture(spark)
    got = headway(df, chunk="1h").toPandas().set_index("JourneyLinkRef")["headway"]
    s = pdf.sort_values(["DateTime", "JourneyLinkRef"])
    exp = (s.groupby("LinkRef")["DateTime"].shift(-1) - s["DateTime"]).dt.total_seconds()
    exp.index = s["JourneyLinkRef"]
    pd.testing.assert_series_equal(got.sort_index(), exp.sort_index(), check_names=False)
