"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully through the no-op sink (every row computed, nothing
collected to the driver) and timed. Prints one JSON line. BENCH_WARM=1 times every query a
second time; BENCH_LINKS=n adds profile, transform and lag windows over n links, made of the
event types and users of the same table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "extract_link_travel_time",
    "seasonal_profile",
    "seasonal_profile_filled",
    "link_scale",
    "remove_outliers",
    "resample_mean_count",
    "zscore_series",
    "lag_windows",
    "horizon_windows",
    "expanding_folds",
    "incumbent_multistep",
    "comparison_frame",
    "scoreboard",
    "scoreboard_by_horizon",
]


def many_links(spark, sf_dir: str, links: int) -> dict[str, float]:
    """Seconds for the profile, the series and the windows of ``links`` links."""
    from pyspark.sql import functions as F
    from linkflow.operators import profile, series, windows
    from linkflow.session import materialize
    from linkflow.sources.adapters import Tables
    obs = Tables(spark, sf_dir).obs()
    types = obs.select("LinkRef").distinct().count()
    obs = obs.withColumn("LinkRef", F.concat_ws("-", "LinkRef", F.col("JourneyRef") % max(1, links // types)))
    times: dict[str, float] = {}

    def timed(name, build):
        t0 = time.perf_counter()
        out = build()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    fitted = timed("profile", lambda: [p := profile.fit_profile(obs), p.slots][0])
    whole = timed("transform", lambda: materialize(series.transform(obs, fitted), "bench-series"))
    timed("lag_windows", lambda: windows.roll(whole, 32, 3).write.format("noop").mode("overwrite").save())
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from linkflow.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), extra={
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    })
    spark.sparkContext.setLogLevel("ERROR")
    from linkflow.plans.catalog import queries
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        try:
            for found in (times, warm) if os.environ.get("BENCH_WARM") else (times,):
                t0 = time.perf_counter()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                found[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep benchmarking the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}
    if warm:
        out["warm"] = warm
    if os.environ.get("BENCH_LINKS"):
        out["links"] = {n: many_links(spark, sf_dir, int(n)) for n in os.environ["BENCH_LINKS"].split(",")}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
