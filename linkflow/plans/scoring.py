"""Scoring forecasts against ground truth.

Line totals (sum over links, minutes) are compared per bin. The comparison frame is
long: ``(bin_ts, model, truth, pred)``; each model is aligned on the truth bins
(left join, a missing forecast bin is a skipped pair). Subsets are tags, so one
grouped aggregation scores every (subset, model) at once -- no per-subset passes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import error_metrics
from ..functions.text import horizon_label
from ..functions.time import day_name, time_of_day_between
from ..session import materialize
from .forecast import line_totals

# Evaluation subsets of the comparison study (name -> predicate on bin_ts and Day).
def default_subsets() -> dict[str, Column]:
    weekday = ~F.col("Day").isin("Saturday", "Sunday")
    return {
        "all": F.lit(True),
        "thursday": F.col("Day") == "Thursday",
        "friday": F.col("Day") == "Friday",
        "weekday_07_09": weekday & time_of_day_between("bin_ts", "07:00", "09:00"),
        "weekday_14_18": weekday & time_of_day_between("bin_ts", "14:00", "18:00"),
        "thursday_07_09": (F.col("Day") == "Thursday") & time_of_day_between("bin_ts", "07:00", "09:00"),
    }


def comparison_frame(truth: DataFrame, models: Mapping[str, DataFrame],
                     tod=("06:00", "22:00")) -> DataFrame:
    """``(bin_ts, Day, model, truth, pred)`` in minutes, truth bins within ``tod`` only."""
    t = line_totals(truth).select("bin_ts", F.col("total").alias("truth"))
    t = t.where(time_of_day_between("bin_ts", *tod)).withColumn("Day", day_name("bin_ts"))
    t = materialize(t, "truth-totals")
    out = None
    for name, df in models.items():
        p = line_totals(df).select("bin_ts", F.col("total").alias("pred"))
        part = t.join(p, "bin_ts", "left").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("bin_ts", "Day", "model", "truth", "pred")


def scoreboard(comparison: DataFrame, subsets: Mapping[str, Column] | None = None) -> DataFrame:
    """``(subset, model, rmse, mae, mape, smape, smape_std, n_pairs)``."""
    subsets = dict(subsets or default_subsets())
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in subsets.items()])
    tagged = comparison.select("*", F.explode(F.array_compact(tags)).alias("subset"))
    return tagged.groupBy("subset", "model").agg(*error_metrics("truth", "pred"))


def truth_by_horizon(truth: DataFrame, horizons: int = 3, step_min: int = 15) -> DataFrame:
    """``(bin_ts, horizon, truth_total)``: the line total h-1 bins after ``bin_ts``.

    A shift by time (a join key moved by (h-1) bins), not a window over all bins.
    """
    t = line_totals(truth, minutes=False).select("bin_ts", F.col("total").alias("truth_total"))
    t = materialize(t, "truth-totals")
    out = None
    for h in range(1, horizons + 1):
        shifted = t.select((F.col("bin_ts") - F.make_dt_interval(F.lit(0), F.lit(0),
                                                                 F.lit(step_min * (h - 1)), F.lit(0)))
                           .alias("bin_ts"), "truth_total").withColumn("horizon", F.lit(h))
        out = shifted if out is None else out.unionByName(shifted)
    return out


def scoreboard_by_horizon(truth: DataFrame, multistep: DataFrame, model: str,
                          eval_from: str, eval_to: str, tod=("06:00", "22:00"),
                          buckets=("15min", "30min", "45min")) -> DataFrame:
    """Per horizon: ``(model, horizon, time_ahead, rmse, mae, mape, smape, n_pairs)``.

    ``multistep`` is ``(Prediction, bin_ts, total_seconds)``; bucket i is horizon i+1
    and is paired with the truth total i bins later. Bins in [eval_from, eval_to]
    (inclusive) and within ``tod`` are scored, in minutes.
    """
    th = truth_by_horizon(truth, len(buckets))
    bucket_h = F.create_map(*[x for i, b in enumerate(buckets) for x in (F.lit(b), F.lit(i + 1))])
    fc = multistep.select(bucket_h[F.col("Prediction")].alias("horizon"), "bin_ts", "total_seconds")
    ev = (F.col("bin_ts") >= F.lit(eval_from).cast("timestamp_ntz")) & \
         (F.col("bin_ts") <= F.lit(eval_to).cast("timestamp_ntz")) & time_of_day_between("bin_ts", *tod)
    pairs = th.where(ev).join(fc, ["bin_ts", "horizon"], "inner")
    scored = pairs.groupBy("horizon").agg(*error_metrics(F.col("truth_total") / 60.0,
                                                         F.col("total_seconds") / 60.0))
    return scored.select(F.lit(model).alias("model"), "horizon",
                         horizon_label("horizon").alias("time_ahead"), *[c for c in scored.columns
                                                                         if c != "horizon"])
