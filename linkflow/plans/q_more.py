"""Registered queries: headway, smoothing, autoregression and lag regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import sql_fixed_mean
from ..functions.metrics import error_metrics
from ..operators import headway as hw
from ..operators import profile as pr
from ..operators import series as se
from ..operators import smoothing as sm
from ..operators import windows as wn
from ..sources.adapters import Tables, with_views
from . import folds as fd
from . import models
from .q_profile import _interp_sql, profile_ctes, profile_sql
from .q_series import LAGS, PREDS, transform_ctes, zseries, zseries_sql
from .registry import query, r4, round_half_away

_HEADWAY_CTE = ("hw", """SELECT *, CAST(date_diff('microsecond', DateTime,
        lead(DateTime) OVER (PARTITION BY LinkRef ORDER BY DateTime, JourneyLinkRef)) AS DOUBLE) / 1e6
        AS headway FROM obs""")


@query("headway", with_views("SELECT JourneyLinkRef, LinkRef, DateTime, headway FROM hw", "obs",
                             extra=[_HEADWAY_CTE]))
def q_headway(spark, sf_dir):
    h = hw.headway(Tables(spark, sf_dir).obs())
    return h.select("JourneyLinkRef", "LinkRef", "DateTime", "headway")


_TOD = "(hour(bin_ts) * 3600 + minute(bin_ts) * 60 + second(bin_ts))"


@query("mean_headway", with_views(f"""
    , hb AS (SELECT time_bucket(INTERVAL '5 minutes', DateTime) AS bin_ts,
                    {sql_fixed_mean('headway')} AS h FROM hw GROUP BY bin_ts),
    hs AS (SELECT unnest(generate_series(min(bin_ts), max(bin_ts), INTERVAL '5 minutes')) AS bin_ts FROM hb),
    hc AS (SELECT 1 AS LinkRef, hs.bin_ts, hb.h, row_number() OVER (ORDER BY hs.bin_ts) AS pos
           FROM hs LEFT JOIN hb USING (bin_ts)),
    hf AS (SELECT bin_ts, {_interp_sql('h', 'pos')[:_interp_sql('h', 'pos').rindex(', first_value')] + ')'} AS h FROM hc)
    SELECT round(avg(h) / 60.0, 4) AS mean_headway_min FROM hf
    WHERE {_TOD} >= 21600 AND {_TOD} <= 79200""", "obs", extra=[_HEADWAY_CTE]))
def q_mean_headway(spark, sf_dir):
    return hw.mean_headway(Tables(spark, sf_dir).obs()).select(r4("mean_headway_min"))


@query("rolling_smooth", profile_sql("""
    SELECT LinkRef, slot, round(coalesce(
        last_value(sm IGNORE NULLS) OVER (PARTITION BY LinkRef ORDER BY slot
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(sm IGNORE NULLS) OVER (PARTITION BY LinkRef ORDER BY slot
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS mean_smooth
    FROM (SELECT LinkRef, slot, CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END AS sm
          FROM prof WINDOW w AS (PARTITION BY LinkRef ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""))
def q_rolling_smooth(spark, sf_dir):
    from ..operators.fill import bfill, pad
    slots = pr.fit_profile(Tables(spark, sf_dir).obs()).slots
    sm_ = sm.rolling_mean(slots, "mean", "LinkRef", "slot", 7, "sm")
    return sm_.select("LinkRef", "slot", r4(F.coalesce(pad("sm", ["LinkRef"], "slot"),
                                                       bfill("sm", ["LinkRef"], "slot")), "mean_smooth"))


# Each value's share in the mean falls by 11/13 a step: beyond 300 steps it is under 1e-21.
@query("ewm", with_views("""
    , seen AS (SELECT JourneyLinkRef, LinkRef, DateTime, LinkTravelTime,
                      row_number() OVER (PARTITION BY LinkRef ORDER BY DateTime, JourneyLinkRef) - 1 AS t
               FROM obs WHERE LinkTravelTime IS NOT NULL)
    SELECT now.JourneyLinkRef, now.LinkRef, now.DateTime, now.LinkTravelTime,
           round(sum(past.LinkTravelTime * power(11.0 / 13.0, now.t - past.t)
                     * CASE WHEN past.t = 0 THEN 1.0 ELSE 2.0 / 13.0 END), 4) AS ewm
    FROM seen now JOIN seen past ON past.LinkRef = now.LinkRef AND past.t BETWEEN now.t - 300 AND now.t
    GROUP BY ALL""", "obs"))
def q_ewm(spark, sf_dir):
    o = Tables(spark, sf_dir).obs()
    return sm.ewm(o, "LinkTravelTime", span=12.0).select(
        "JourneyLinkRef", "LinkRef", "DateTime", "LinkTravelTime", r4("ewm"))


@query("sar_one_lag", zseries_sql("""
    SELECT LinkRef, regr_count(y, x) AS n, round(regr_slope(y, x), 4) AS slope,
           round(regr_intercept(y, x), 4) AS intercept
    FROM (SELECT LinkRef, z AS y, lag(z) OVER (PARTITION BY LinkRef ORDER BY bin_ts) AS x FROM zs)
    GROUP BY LinkRef"""))
def q_sar_one_lag(spark, sf_dir):
    s = models.sar_one_lag(zseries(spark, sf_dir))
    return s.select("LinkRef", "n", r4("slope"), r4("intercept"))


# Least squares by orthogonal regressors: q1 .. q3 are the lags freed from the earlier ones,
# q4 the previous error freed from all lags; a fitted value is the mean plus slope * q of each.
def _slope(y: str, x: str) -> str:
    return f"regr_slope({y}, {x}) OVER (PARTITION BY LinkRef)"


def _mean(y: str) -> str:
    return f"avg({y}) OVER (PARTITION BY LinkRef)"


def _freed(y: str, *qs: str) -> str:
    return f"{y} - {_mean(y)}" + "".join(f" - {_slope(y, q)} * {q}" for q in qs)


_SAR_CTES = [
    ("lagged", """SELECT * FROM (
        SELECT LinkRef, bin_ts, weight, z AS y, lag(z, 1) OVER w AS x1, lag(z, 2) OVER w AS x2, lag(z, 3) OVER w AS x3
        FROM zs WINDOW w AS (PARTITION BY LinkRef ORDER BY bin_ts)) WHERE x3 IS NOT NULL"""),
    ("o1", f"SELECT *, {_freed('x1')} AS q1 FROM lagged"),
    ("o2", f"SELECT *, {_freed('x2', 'q1')} AS q2 FROM o1"),
    ("o3", f"SELECT *, {_freed('x3', 'q1', 'q2')} AS q3 FROM o2"),
    ("e1", f"SELECT *, {_freed('y', 'q1', 'q2', 'q3')} AS e FROM o3"),
    ("e2", "SELECT *, coalesce(lag(e) OVER (PARTITION BY LinkRef ORDER BY bin_ts), 0.0) AS x4 FROM e1"),
    ("o4", f"SELECT *, {_freed('x4', 'q1', 'q2', 'q3')} AS q4 FROM e2"),
    ("steps", f"SELECT *, {_freed('y', 'q1', 'q2', 'q3', 'q4')} AS error FROM o4"),
]


@query("sar_two_stage", zseries_sql("""
    , s AS (SELECT LinkRef, count(*) AS n, regr_slope(y, q4) AS b4, regr_slope(y, q3) AS y3, regr_slope(x4, q3) AS x43,
                   regr_slope(y, q2) AS y2, regr_slope(x3, q2) AS x32, regr_slope(x4, q2) AS x42,
                   regr_slope(y, q1) AS y1, regr_slope(x2, q1) AS x21, regr_slope(x3, q1) AS x31, regr_slope(x4, q1) AS x41,
                   avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4
            FROM steps GROUP BY LinkRef),
    s3 AS (SELECT *, y3 - b4 * x43 AS b3 FROM s),
    s2 AS (SELECT *, y2 - b3 * x32 - b4 * x42 AS b2 FROM s3),
    s1 AS (SELECT *, y1 - b2 * x21 - b3 * x31 - b4 * x41 AS b1 FROM s2)
    SELECT LinkRef, n, round(my - b1 * m1 - b2 * m2 - b3 * m3 - b4 * m4, 4) AS intercept, round(b1, 4) AS lag_1,
           round(b2, 4) AS lag_2, round(b3, 4) AS lag_3, round(b4, 4) AS lag_error FROM s1""", post=_SAR_CTES))
def q_sar_two_stage(spark, sf_dir):
    fitted, _ = models.sar_fit(zseries(spark, sf_dir))
    return fitted.select("LinkRef", "n", *[r4(c) for c in ("intercept", "lag_1", "lag_2", "lag_3", "lag_error")])


@query("sar_error_series", zseries_sql("""
    SELECT LinkRef, bin_ts, round(y, 4) AS y, round(error, 4) AS error, weight FROM steps""", post=_SAR_CTES))
def q_sar_error_series(spark, sf_dir):
    _, steps = models.sar_fit(zseries(spark, sf_dir))
    return steps.select("LinkRef", "bin_ts", r4("y"), r4("error"), "weight")


@query("weighted_rmse", zseries_sql("""
    SELECT round(sqrt(avg(e * e)), 4) AS rmse_sar, round(sqrt(avg(h * h)), 4) AS rmse_ha, count(*) AS n
    FROM (SELECT bin_ts, sum(weight * error / 60.0) AS e, sum(weight * y / 60.0) AS h FROM steps GROUP BY bin_ts)""",
    post=_SAR_CTES))
def q_weighted_rmse(spark, sf_dir):
    _, steps = models.sar_fit(zseries(spark, sf_dir))
    return models.weighted_rmse(steps).select(r4("rmse_sar"), r4("rmse_ha"), "n")


FOLDS, BOOTSTRAP, STEP = 4, 0.80, 0.05


def _fold_state(spark, sf_dir) -> fd.FoldState:
    return fd.fold_state(Tables(spark, sf_dir).obs().where("LinkTravelTime is not null"), BOOTSTRAP, STEP, FOLDS)


def _fold_forecasts(spark, sf_dir) -> DataFrame:
    """Models fitted on each fold's train windows, applied to its test windows, in seconds."""
    train, test = fd.fold_windows(_fold_state(spark, sf_dir), LAGS, PREDS)
    return in_seconds(models.lag_regression(train, test, PREDS, fd.FOLD))


def in_seconds(scored: DataFrame) -> DataFrame:
    return scored.select("fold", "LinkRef", "bin_ts", "horizon", "weight", "z_true", "z_pred",
                         (F.col("z_true") * F.col("scale") + F.col("mean")).alias("truth"),
                         (F.col("z_pred") * F.col("scale") + F.col("mean")).alias("model"),
                         F.col("mean").alias("baseline"))


def _fold_totals(rows: DataFrame, *columns: str) -> DataFrame:
    """Weight-summed line totals in minutes, bins with a positive true total only."""
    return (rows.groupBy("fold", "horizon", "bin_ts")
            .agg(*[(F.sum(F.col(c) * F.col("weight")) / 60.0).alias(c) for c in columns])
            .where(F.col("truth") > 0))


def _fold_ctes(train_too: bool) -> list[tuple[str, str]]:
    """DuckDB: {test,train}windows(fold, LinkRef, bin_ts, t, n_bins, z, mean, scale, weight) of every fold."""
    ctes = [("numbered", """SELECT *, row_number() OVER (ORDER BY DateTime, JourneyLinkRef) - 1 AS rn,
                                   count(*) OVER () AS n FROM obs WHERE LinkTravelTime IS NOT NULL""")]
    sides = ["test", "train"] if train_too else ["test"]
    for i in range(FOLDS):
        cut = [f"CAST(floor((CAST({BOOTSTRAP} AS DOUBLE) + {k} * CAST({STEP} AS DOUBLE)) * n) AS BIGINT)" for k in (i, i + 1)]
        ctes += [(f"train{i}", f"SELECT * FROM numbered WHERE rn < {cut[0]}"),
                 (f"test{i}", f"SELECT * FROM numbered WHERE rn >= {cut[0]} AND rn < {cut[1]}"),
                 *profile_ctes(f"train{i}", f"f{i}_")]
        for side in sides:
            ctes += transform_ctes(f"{side}{i}", f"f{i}_", f"z{side}{i}")
    for side in sides:
        ctes.append((f"{side}windows", " UNION ALL ".join(
            f"""SELECT {i} AS fold, LinkRef, bin_ts, z, mean, scale, weight, row_number() OVER (PARTITION BY LinkRef ORDER BY bin_ts) - 1 AS t,
                       count(*) OVER (PARTITION BY LinkRef) AS n_bins FROM z{side}{i}""" for i in range(FOLDS))))
    return ctes


_VALID = f"a.t >= {LAGS} AND a.t < a.n_bins - {PREDS}"


def _fold_board_sql() -> str:
    return with_views(f"""
        SELECT CAST(fold AS INTEGER) AS fold, CAST(horizon AS INTEGER) AS horizon,
               round(sqrt(avg((truth - baseline) ** 2)), 4) AS rmse, round(avg(abs(truth - baseline)), 4) AS mae,
               round(avg(abs(truth - baseline) / truth) * 100, 4) AS mape, count(*) AS n_pairs
        FROM (SELECT a.fold, k AS horizon, a.bin_ts, sum((b.z * b.scale + b.mean) * b.weight) / 60 AS truth,
                     sum(b.mean * b.weight) / 60 AS baseline
              FROM testwindows a, generate_series(1, {PREDS}) g(k), testwindows b
              WHERE {_VALID} AND b.fold = a.fold AND b.LinkRef = a.LinkRef AND b.t = a.t + k - 1
              GROUP BY a.fold, k, a.bin_ts) WHERE truth > 0 GROUP BY fold, horizon""", "obs", extra=_fold_ctes(False))


def _lists(windows: str, where: str = "TRUE") -> str:
    """Windows as lists (1, lags oldest first, horizons)."""
    return f"""SELECT fold, LinkRef, bin_ts, list_concat([1.0::DOUBLE], zs[:{LAGS + PREDS}]) AS v FROM (
        SELECT *, list(z) OVER (PARTITION BY fold, LinkRef ORDER BY t
                ROWS BETWEEN {LAGS} PRECEDING AND {PREDS - 1} FOLLOWING) AS zs FROM {windows}) a WHERE {_VALID} AND {where}"""


_WIDTH = 1 + LAGS + PREDS


def product_ctes(windows: str, where: str = "TRUE") -> list[tuple[str, str]]:
    """DuckDB: ``sums`` of products of (1, lags, horizons), a row per fold and first factor."""
    return [("vs", f"SELECT fold, i, v[i] AS x, v FROM ({_lists(windows, where)}), generate_series(1, {_WIDTH}) g(i)"),
            ("sums", f"""SELECT fold, i, {', '.join(f'sum(x * v[{j}]) AS c{j}' for j in range(1, _WIDTH + 1))}
                         FROM vs GROUP BY fold, i""")]


@query("lag_product_sums", with_views(f"""
    SELECT CAST(fold AS INTEGER) AS fold, CAST((i - 1) * {_WIDTH} + j - 1 AS INTEGER) AS position,
           round([{', '.join(f'c{j}' for j in range(1, _WIDTH + 1))}][j], 4) AS total
    FROM sums, generate_series(1, {_WIDTH}) g(j)""", "obs", extra=_fold_ctes(True) + product_ctes("trainwindows")))
def q_lag_product_sums(spark, sf_dir):
    """Sums of products of (1, lags, horizons) over the train windows of every fold."""
    train, _ = fd.fold_windows(_fold_state(spark, sf_dir), LAGS, PREDS)
    return models.product_sums(train, fd.FOLD).select("fold", "position", r4("total"))


def solved_ctes(windows: str, where: str = "TRUE") -> list[tuple[str, str]]:
    """DuckDB: ``seconds``, the forecasts of ``windows`` by the least squares of ``sums``.

    Gauss-Jordan elimination of the normal equations, one row of (lags | horizons) a step.
    """
    return [
        ("m0", f"SELECT fold, list([{', '.join(f'c{j}' for j in range(1, _WIDTH + 1))}] ORDER BY i) AS m FROM sums WHERE i <= {1 + LAGS} GROUP BY fold"),
        ("gj", f"""SELECT fold, 0 AS k, m FROM m0 UNION ALL
            SELECT fold, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
                ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gj WHERE k < {1 + LAGS}"""),
        ("forecast", f"""SELECT w.fold, LinkRef, bin_ts, h AS horizon, v[{1 + LAGS} + h] AS z_true,
                list_sum(list_transform(v[:{1 + LAGS}], lambda x, i: x * m[i][{1 + LAGS} + h])) AS z_pred
            FROM ({_lists(windows, where)}) w JOIN gj ON gj.fold = w.fold AND k = {1 + LAGS}, generate_series(1, {PREDS}) g(h)"""),
        ("seconds", f"""SELECT f.fold, f.LinkRef, f.bin_ts, f.horizon, b.weight, z_true, z_pred, z_true * b.scale + b.mean AS truth,
                z_pred * b.scale + b.mean AS model, b.mean AS baseline
            FROM forecast f JOIN {windows} a USING (fold, LinkRef, bin_ts) JOIN {windows} b
              ON b.fold = f.fold AND b.LinkRef = f.LinkRef AND b.t = a.t + f.horizon - 1"""),
    ]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _forecast_sql(select: str) -> str:
    return recursive(with_views(select, "obs", extra=_fold_ctes(True) + product_ctes("trainwindows") + solved_ctes("testwindows")))


_IN_SECONDS = ("z_true", "z_pred", "truth", "model", "baseline")


@query("lag_regression", _forecast_sql(f"""
    SELECT CAST(fold AS INTEGER) AS fold, LinkRef, bin_ts, CAST(horizon AS INTEGER) AS horizon, weight,
           {', '.join(f'round({c}, 3) AS {c}' for c in _IN_SECONDS)} FROM seconds"""))
def q_lag_regression(spark, sf_dir):
    """Out-of-sample forecast of every fold, all folds and horizons fitted in one pass."""
    return _fold_forecasts(spark, sf_dir).select("fold", "LinkRef", "bin_ts", "horizon", "weight",
                                                 *[round_half_away(c, 3).alias(c) for c in _IN_SECONDS])


@query("scoreboard_by_fold", _fold_board_sql())
def q_scoreboard_by_fold(spark, sf_dir):
    """Historical average against truth per expanding fold and horizon."""
    state = _fold_state(spark, sf_dir)
    test = state.series(state.fit(), state.test_cells())
    hz = wn.explode_horizons(wn.roll(test, LAGS, PREDS, key=["fold", "LinkRef"]), key=["fold", "LinkRef"])
    rows = hz.select("fold", "horizon", "bin_ts", "weight", F.col("mean").alias("baseline"),
                     (F.col("z") * F.col("scale") + F.col("mean")).alias("truth"))
    board = _fold_totals(rows, "truth", "baseline").groupBy("fold", "horizon").agg(*error_metrics("truth", "baseline"))
    return board.select("fold", "horizon", r4("rmse"), r4("mae"), r4("mape"), "n_pairs")


_KEPT = ("rmse", "mae", "mape")


def _side_sql(side: str) -> str:
    return (f"sqrt(avg((truth - {side}) ** 2)) AS {side}_rmse, avg(abs(truth - {side})) AS {side}_mae, "
            f"avg(abs(truth - {side}) / truth) * 100 AS {side}_mape")


MODEL_BOARD_SQL = f"""
    SELECT CAST(fold AS INTEGER) AS fold, CAST(horizon AS INTEGER) AS horizon,
           {', '.join(f'round({s}_{m}, 3) AS {s}_{m}' for s in ('baseline', 'model') for m in _KEPT)},
           {', '.join(f'round(model_{m} - baseline_{m}, 3) AS difference_{m}' for m in _KEPT)}, n_pairs
    FROM (SELECT fold, horizon, {_side_sql('baseline')}, {_side_sql('model')}, count(*) AS n_pairs
          FROM (SELECT fold, horizon, bin_ts, sum(truth * weight) / 60 AS truth, sum(baseline * weight) / 60 AS baseline,
                       sum(model * weight) / 60 AS model FROM seconds GROUP BY fold, horizon, bin_ts)
          WHERE truth > 0 GROUP BY fold, horizon)"""


def model_board(forecasts: DataFrame) -> DataFrame:
    """Baseline, model and their difference per fold and horizon, over weighted line totals."""
    totals = _fold_totals(forecasts, "truth", "baseline", "model")
    board = totals.groupBy("fold", "horizon").agg(*error_metrics("truth", "baseline", "baseline_"),
                                                  *error_metrics("truth", "model", "model_"))

    def r3(c, name):
        return round_half_away(c, 3).alias(name)

    return board.select("fold", "horizon", *[r3(f"{side}_{m}", f"{side}_{m}") for side in ("baseline", "model") for m in _KEPT],
                        *[r3(F.col(f"model_{m}") - F.col(f"baseline_{m}"), f"difference_{m}") for m in _KEPT],
                        F.col("model_n_pairs").alias("n_pairs"))


@query("scoreboard_model_by_fold", _forecast_sql(MODEL_BOARD_SQL))
def q_scoreboard_model_by_fold(spark, sf_dir):
    """Baseline, lag model and their difference per fold and horizon."""
    return model_board(_fold_forecasts(spark, sf_dir))
