"""Linear forecasters trained on Spark (re-aimed from single-machine networks).

* ``least_squares``: ordinary least squares per key from the normal equations. The sums of
  products are one grouped aggregation; one row of sums per key is solved in numpy.
* ``sar_fit``: per link, z(t) on its last ``lags`` values; then a refit with the previous
  one-step error of that first model as one more regressor (0 where there is none before).
  Two least-squares fits stand for the original one-sample-at-a-time training.
* ``sar_recursive``: that model's own errors, run along the training and the test series.
* ``lag_regression``: least squares of every horizon on the lag vector of each (link, bin)
  window, fitted on one set of windows and applied to another. One pass sums the products of
  lags and horizons of every fold; one small system per fold is solved for all horizons.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds, freq_seconds
from ..operators.recurrence import linear_recurrence
from ..session import materialize


def _solved(bound: float | None):
    def run(frames):
        for pdf in frames:
            out = []
            for sums, right in zip(pdf["_xx"], pdf["_xy"]):
                xx, xy = np.array(sums, float).reshape(len(right), -1), np.array(right, float)
                coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
                if bound is not None and abs(coef[-1]) > bound:
                    last = np.clip(coef[-1], -bound, bound)
                    coef = np.append(np.linalg.lstsq(xx[:-1, :-1], xy[:-1] - last * xx[:-1, -1], rcond=None)[0], last)
                out.append(coef)
            pdf["coef"] = out
            yield pdf.drop(columns=["_xx", "_xy"])

    return run


def least_squares(rows: DataFrame, key: str, y: str, xs: Sequence[str], bound: float | None = None) -> DataFrame:
    """``(key, n, coef)``: intercept and one coefficient per regressor, over rows without NULLs.

    ``bound``: the last coefficient stays within it, the others are the best beside it.
    """
    whole = rows.dropna(subset=[y, *xs])
    design = [F.lit(1.0)] + [F.col(x) for x in xs]
    sums = whole.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(a * b) for a in design for b in design]).alias("_xx"),
        F.array(*[F.sum(a * F.col(y)) for a in design]).alias("_xy"))
    return sums.mapInPandas(_solved(bound), f"{key} {rows.schema[key].dataType.simpleString()}, n long, coef array<double>")


def _predicted(xs: Sequence[str]):
    total = F.col("coef")[0]
    for i, x in enumerate(xs):
        total = total + F.col("coef")[i + 1] * F.col(x)
    return total


def sar_fit(series: DataFrame, lags: int = 3, key: str = "LinkRef", order: str = "bin_ts", bound: float | None = None):
    """(coefficients of the refit, its one-step errors); ``bound`` holds the error's coefficient.

    Coefficients: ``(key, n, intercept, lag_1 .. lag_n, lag_error)``. Errors: ``(key, order, y,
    pred, error, weight)`` for every position with all lags.
    """
    w = Window.partitionBy(key).orderBy(order)
    xs = [f"lag_{i}" for i in range(1, lags + 1)]
    rows = series.select(key, order, F.col("z").alias("y"), "weight",
                         *[F.lag("z", i).over(w).alias(x) for i, x in enumerate(xs, 1)]).dropna(subset=["y", *xs])
    rows = materialize(rows, "sar-rows")
    first = materialize(least_squares(rows, key, "y", xs).select(key, "coef"), "sar-first")
    errors = rows.join(first, key).withColumn("_e", F.col("y") - _predicted(xs)).drop("coef")
    again = materialize(errors.withColumn("lag_error", F.coalesce(F.lag("_e").over(w), F.lit(0.0))), "sar-again")
    both = [*xs, "lag_error"]
    second = materialize(least_squares(again, key, "y", both, bound), "sar-second")
    coefficients = second.select(key, "n", F.col("coef")[0].alias("intercept"),
                                 *[F.col("coef")[i].alias(x) for i, x in enumerate(both, 1)])
    steps = (again.join(second.select(key, "coef"), key).withColumn("pred", _predicted(both))
             .select(key, order, "y", "pred", (F.col("y") - F.col("pred")).alias("error"), "weight"))
    return coefficients, steps


def sar_recursive(coefficients: DataFrame, parts: Mapping[str, DataFrame], lags: int = 3, freq="15min") -> DataFrame:
    """``(part, LinkRef, bin_ts, y, error, weight)``: one-step errors run along each series.

    ``pred_t = intercept + lags + lag_error * e_{t-1}`` and ``e_t = y_t - pred_t``, e before the
    first forecast 0: the error of the model itself is fed back, so it is a recurrence
    (``operators.recurrence``). ``coefficients`` come from ``sar_fit`` on the training series;
    ``parts`` are the series it is run through, seen or not.
    """
    both = None
    for name, series in parts.items():
        one = series.select(F.lit(name).alias("part"), "LinkRef", "bin_ts", "z", "weight")
        both = one if both is None else both.unionByName(one)
    w = Window.partitionBy("part", "LinkRef").orderBy("bin_ts")
    xs = [f"x_{i}" for i in range(1, lags + 1)]
    rows = both.select("part", "LinkRef", "bin_ts", F.floor(epoch_seconds("bin_ts") / freq_seconds(freq)).alias("_bin"), F.col("z").alias("y"),
                       "weight", *[F.lag("z", i).over(w).alias(x) for i, x in enumerate(xs, 1)]).dropna(subset=xs)
    alone = F.col("y") - F.col("intercept")
    for i, x in enumerate(xs, 1):
        alone = alone - F.col(f"lag_{i}") * F.col(x)
    free = rows.join(coefficients, "LinkRef").select("part", "LinkRef", "bin_ts", "_bin", "y", "weight", alone.alias("alone"),
                                                     (-F.col("lag_error")).alias("factor"))
    free = materialize(free, "sar-parts")
    errors = linear_recurrence(free, ["part", "LinkRef"], "_bin", "alone", "factor", "error")
    return free.join(errors, ["part", "LinkRef", "_bin"]).select("part", "LinkRef", "bin_ts", "y", "error", "weight")


def weighted_rmse(steps: DataFrame, order: str = "bin_ts", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., rmse_sar, rmse_ha, n)``: root mean square over bins of the weighted total error, a 60th.

    The historical average forecasts a normalised value of 0, so its error is y itself.
    """
    totals = steps.groupBy(*by, order).agg(F.sum(F.col("weight") * F.col("error") / 60.0).alias("e"),
                                      F.sum(F.col("weight") * F.col("y") / 60.0).alias("h"))
    return totals.groupBy(*by).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_sar"),
                      F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("rmse_ha"), F.count(F.lit(1)).alias("n"))


def sar_one_lag(series: DataFrame, key: str = "LinkRef", order: str = "bin_ts") -> DataFrame:
    """``(key, n, slope, intercept)`` of z(t) on z(t-1)."""
    w = Window.partitionBy(key).orderBy(order)
    lagged = series.select(key, F.col("z").alias("y"), F.lag("z").over(w).alias("x"))
    return lagged.groupBy(key).agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"),
                                   F.regr_intercept("y", "x").alias("intercept"))


def _gram_rows(by: Sequence[str], schema: pa.Schema):
    """Per partition and ``by``: the sums of products of (1, X, Y) over the windows, flattened."""
    def run(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.array(b.column(b.schema.names.index(c)).to_pylist(), float) for c in ("X", "Y"))
            whole = np.column_stack([np.ones(len(x)), x, y])
            keys = list(zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in by))) if by else [()] * len(x)
            for key in dict.fromkeys(keys):
                rows = whole[[k == key for k in keys]]
                sums[key] = sums.get(key, 0.0) + rows.T @ rows
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in sums], schema.field(c).type) for i, c in enumerate(by)]
                + [pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], names=[*by, "sums"])

    return run


def product_sums(rolled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., position, total)``: sums of products of (1, X, Y), row-major, over all windows of each ``by``.

    Every partition sends one matrix per ``by``; matrices are added position by position. They
    are all that least squares of every horizon needs, and sums of disjoint windows add up.
    """
    by = list(by)
    fields = [f for f in rolled.schema if f.name in by]
    schema = ", ".join([f"`{c}` {rolled.schema[c].dataType.simpleString()}" for c in by] + ["sums array<double>"])
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    parts = rolled.select(*by, "X", "Y").mapInArrow(_gram_rows(by, arrow), schema)
    return parts.select(*by, F.posexplode("sums").alias("position", "total")).groupBy(*by, "position").agg(F.sum("total").alias("total"))


def _solved_horizons(preds: int):
    def run(frames):
        for pdf in frames:
            out = []
            for flat in pdf["_sums"]:
                n = int(round(len(flat) ** 0.5))
                m = np.array(flat, float).reshape(n, n)
                k = n - preds
                out.append(np.linalg.lstsq(m[:k, :k], m[:k, k:], rcond=None)[0].T.tolist())
            pdf["coef"] = out
            yield pdf.drop(columns=["_sums"])

    return run


def lag_coefficients(sums: DataFrame, preds: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., coef)``: intercept and lag coefficients for every horizon, from ``product_sums``."""
    flat = F.transform(F.sort_array(F.collect_list(F.struct("position", "total"))), lambda c: c["total"]).alias("_sums")
    schema = ", ".join([f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by] + ["coef array<array<double>>"])
    return (sums.groupBy(*by).agg(flat) if by else sums.agg(flat)).where("size(_sums) > 0").mapInPandas(_solved_horizons(preds), schema)


def apply_lag_regression(coefficients: DataFrame, rolled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., LinkRef, bin_ts, horizon, z_true, z_pred, mean, scale, weight)`` in one pass over the windows.

    ``coefficients`` has one row per ``by`` (folds), whatever the number of links and windows.
    """
    joined = rolled.join(F.broadcast(coefficients), list(by)) if by else rolled.crossJoin(F.broadcast(coefficients))
    design = F.concat(F.array(F.lit(1.0)), F.col("X"))
    out = joined.select(*by, "LinkRef", "bin_ts", design.alias("_x"), F.posexplode(
        F.arrays_zip("coef", "Y", "Y_mean", "Y_scale", "Y_weight")).alias("_h", "_s"))
    linear = F.aggregate(F.zip_with("_x", F.col("_s.coef"), lambda x, c: x * c), F.lit(0.0), lambda total, part: total + part)
    return out.select(*by, "LinkRef", "bin_ts", (F.col("_h") + 1).cast("int").alias("horizon"), F.col("_s.Y").alias("z_true"), linear.alias("z_pred"),
                      F.col("_s.Y_mean").alias("mean"), F.col("_s.Y_scale").alias("scale"), F.col("_s.Y_weight").alias("weight"))


def lag_regression(train: DataFrame, test: DataFrame, preds: int, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of every horizon on the lags of ``train`` windows, applied to ``test`` windows.

    ``by`` (such as the fold) names columns of both; all its models are fitted in one pass.
    """
    fitted = materialize(lag_coefficients(product_sums(train, by), preds, by), "lag-coefficients")
    return apply_lag_regression(fitted, test, by)
