"""Registered queries of the studies beside the main line: autoregression out of sample, folds by
window position, the older preparation, the fitted model in the comparison, sizes of folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import day_name, reference_timestamp, time_of_day_between
from ..operators import outliers as ol
from ..operators import profile as pr
from ..operators import series as se
from ..operators import splits as sp
from ..operators import windows as wn
from ..session import materialize, scratch_table_path
from ..sources.adapters import Tables, link_dimension, with_views
from ..sources.sinks import write_forecast
from . import folds as fd
from . import models
from . import scoring as sc
from .q_forecast import COMPARISON_CTES, _metrics_sql, _models, _round_metrics, _split, _SUBSET_SQL, _totals_sql, _truth, forecast_ctes
from .q_more import BOOTSTRAP, FOLDS, MODEL_BOARD_SQL, STEP, _fold_forecasts, _forecast_sql, _SAR_CTES, in_seconds, model_board, product_ctes, recursive, solved_ctes
from .q_profile import FILLED_SQL, SLOT_SQL, profile_ctes, profile_sql
from .q_series import LAGS, ORDER, PREDS, _POS_CTE, _RN_CTE, transform_ctes, zseries, zseries_sql
from .registry import query, r4, round_half_away


def obs(spark, sf_dir):
    return Tables(spark, sf_dir).obs()


# ------------------------------------------------- autoregression, out of sample

TRAIN_SHARE = 0.95
STABLE = 0.95                  # largest share of an error that is fed back: a larger one makes errors grow without end


def _sar_parts(spark, sf_dir):
    """{part: series}: split by rows in time, outliers removed and scaled by the train profile."""
    o = obs(spark, sf_dir)
    train, test = sp.row_fraction_split(o, TRAIN_SHARE, ORDER)
    profile = pr.fit_profile(train)
    return {name: se.transform(ol.remove_outliers(part, profile.slots), profile) for name, part in (("train", train), ("test", test))}


def _sar_errors(spark, sf_dir):
    parts = {name: materialize(series, f"sar-{name}") for name, series in _sar_parts(spark, sf_dir).items()}
    coefficients, _ = models.sar_fit(parts["train"], bound=STABLE)
    return models.sar_recursive(coefficients, parts)


def _inside(src: str) -> str:
    slot = SLOT_SQL.replace("DayOfWeek", "o.DayOfWeek").replace("DateTime", "o.DateTime")
    return (f"SELECT o.* FROM {src} o JOIN prof pf ON pf.LinkRef = o.LinkRef AND pf.slot = {slot} "
            "WHERE o.LinkTravelTime > pf.low AND o.LinkTravelTime < pf.upr")


_CUT = f"CAST(floor(CAST({TRAIN_SHARE} AS DOUBLE) * CAST(n AS DOUBLE)) AS BIGINT)"
# The recurrence written out: an error is a sum over earlier ones, each share smaller by the factor.
_SAR_PARTS = [
    _RN_CTE, ("train", f"SELECT * FROM rn WHERE rn < {_CUT}"), ("test", f"SELECT * FROM rn WHERE rn >= {_CUT}"),
    *profile_ctes("train"), ("train_in", _inside("train")), ("test_in", _inside("test")),
    *transform_ctes("train_in", "", "zs"), *transform_ctes("test_in", "", "zt"), *_SAR_CTES,
    ("s", """SELECT LinkRef, count(*) AS n, regr_slope(y, q4) AS b4, regr_slope(y, q3) AS y3, regr_slope(x4, q3) AS x43,
                   regr_slope(y, q2) AS y2, regr_slope(x3, q2) AS x32, regr_slope(x4, q2) AS x42,
                   regr_slope(y, q1) AS y1, regr_slope(x2, q1) AS x21, regr_slope(x3, q1) AS x31, regr_slope(x4, q1) AS x41,
                   avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4
            FROM steps GROUP BY LinkRef"""),
    ("s4", f"SELECT * REPLACE (greatest(least(b4, {STABLE}), -{STABLE}) AS b4) FROM s"), ("s3", "SELECT *, y3 - b4 * x43 AS b3 FROM s4"), ("s2", "SELECT *, y2 - b3 * x32 - b4 * x42 AS b2 FROM s3"),
    ("s1", "SELECT *, y1 - b2 * x21 - b3 * x31 - b4 * x41 AS b1 FROM s2"),
    ("coef", "SELECT LinkRef, my - b1 * m1 - b2 * m2 - b3 * m3 - b4 * m4 AS a, b1, b2, b3, b4 FROM s1"),
    ("both_parts", "SELECT 'train' AS part, * FROM zs UNION ALL SELECT 'test' AS part, * FROM zt"),
    ("free", """SELECT part, LinkRef, bin_ts, y, weight, b4, y - a - b1 * x1 - b2 * x2 - b3 * x3 AS c,
            row_number() OVER (PARTITION BY part, LinkRef ORDER BY bin_ts) AS t
        FROM (SELECT part, LinkRef, bin_ts, weight, z AS y, lag(z, 1) OVER w AS x1, lag(z, 2) OVER w AS x2, lag(z, 3) OVER w AS x3
              FROM both_parts WINDOW w AS (PARTITION BY part, LinkRef ORDER BY bin_ts)) JOIN coef USING (LinkRef) WHERE x3 IS NOT NULL"""),
    ("errors", """SELECT now.part, now.LinkRef, now.bin_ts, now.y, now.weight, sum(past.c * power(-now.b4, now.t - past.t)) AS error
        FROM free now JOIN free past ON past.part = now.part AND past.LinkRef = now.LinkRef AND past.t BETWEEN now.t - 300 AND now.t
        GROUP BY ALL"""),
]


@query("sar_out_of_sample_errors", with_views("""
    SELECT part, LinkRef, bin_ts, round(y, 4) AS y, round(error, 2) AS error, weight FROM errors""", "obs", extra=_SAR_PARTS))
def q_sar_out_of_sample_errors(spark, sf_dir):
    """One-step errors of the autoregression fitted on the first 95 % of rows, along train and test part."""
    return _sar_errors(spark, sf_dir).select("part", "LinkRef", "bin_ts", r4("y"), round_half_away("error", 2).alias("error"), "weight")   # nearly collinear regressors


@query("weighted_rmse_by_part", with_views("""
    SELECT part, round(sqrt(avg(e * e)), 4) AS rmse_sar, round(sqrt(avg(h * h)), 4) AS rmse_ha, count(*) AS n
    FROM (SELECT part, bin_ts, sum(weight * error / 60.0) AS e, sum(weight * y / 60.0) AS h FROM errors GROUP BY part, bin_ts)
    GROUP BY part""", "obs", extra=_SAR_PARTS))
def q_weighted_rmse_by_part(spark, sf_dir):
    return models.weighted_rmse(_sar_errors(spark, sf_dir), by=["part"]).select("part", r4("rmse_sar"), r4("rmse_ha"), "n")


# ---------------------------------------------------------- folds by window position

P_BOOTSTRAP, P_STEP, P_FOLDS = 0.75, 0.05, 5


def _position_windows(spark, sf_dir):
    """(windows with their segment, number of folds)."""
    rolled = materialize(wn.roll(zseries(spark, sf_dir), LAGS, PREDS).withColumn("p", F.col("t") - LAGS), "position-windows")
    n = (rolled.agg(F.max("p")).first()[0] or 0) + 1
    return sp.tag_position_folds(rolled, "p", n, P_BOOTSTRAP, P_STEP, P_FOLDS)


def _bound(i: str) -> str:
    return f"CAST(floor(w * CAST({P_BOOTSTRAP} AS DOUBLE)) AS BIGINT) + {i} * CAST(floor(w * CAST({P_STEP} AS DOUBLE)) AS BIGINT)"


_POSITION_CTES = [
    _POS_CTE, ("width", f"SELECT max(n_bins) - {LAGS + PREDS} AS w FROM pos"),
    ("fold_bounds", f"SELECT fold, {_bound('fold')} AS a, least({_bound('(fold + 1)')}, w) AS b FROM width, generate_series(0, {P_FOLDS - 1}) g(fold) WHERE {_bound('fold')} < w"),
    ("pwindows", "SELECT fold, a AS from_p, b AS to_p, pos.* FROM pos, fold_bounds"),
]


@query("position_folds", zseries_sql(f"""
    SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n_windows, min(bin_ts) AS first_bin, max(bin_ts) AS last_bin
    FROM (SELECT fold, bin_ts, CASE WHEN t - {LAGS} < from_p THEN 'train' ELSE 'test' END AS part FROM pwindows
          WHERE t >= {LAGS} AND t < n_bins - {PREDS} AND t - {LAGS} < to_p) GROUP BY fold, part""", post=_POSITION_CTES))
def q_position_folds(spark, sf_dir):
    """Windows of the train and test part of each fold by position."""
    tagged, folds = _position_windows(spark, sf_dir)
    seg = tagged.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("bin_ts").alias("f"), F.max("bin_ts").alias("l"))
    train = fd.training(seg, folds).withColumn("part", F.lit("train"))
    test = seg.where(F.col("segment").between(0, folds - 1)).withColumnRenamed("segment", "fold").withColumn("part", F.lit("test"))
    return train.unionByName(test).groupBy("fold", "part").agg(
        F.sum("n").alias("n_windows"), F.min("f").alias("first_bin"), F.max("l").alias("last_bin")).select(
        F.col("fold").cast("int").alias("fold"), "part", "n_windows", "first_bin", "last_bin")


@query("scoreboard_by_position_fold", recursive(zseries_sql(MODEL_BOARD_SQL, post=[
    *_POSITION_CTES, *product_ctes("pwindows", f"t - {LAGS} < from_p"),
    *solved_ctes("pwindows", f"t - {LAGS} >= from_p AND t - {LAGS} < to_p")])))
def q_scoreboard_by_position_fold(spark, sf_dir):
    """Lag models of all position folds: sums of products per segment, added up over what trains a fold."""
    tagged, folds = _position_windows(spark, sf_dir)
    parts = materialize(models.product_sums(tagged, ["segment"]), "segment-sums")
    sums = fd.training(parts, folds).groupBy("fold", "position").agg(F.sum("total").alias("total"))
    fitted = materialize(models.lag_coefficients(sums, PREDS, ["fold"]), "lag-coefficients")
    test = tagged.where(F.col("segment").between(0, folds - 1)).withColumnRenamed("segment", "fold")
    return model_board(in_seconds(models.apply_lag_regression(fitted, test, ["fold"])))


# -------------------------------------------------------------- older preparation

def _older_ctes() -> list[tuple[str, str]]:
    up = "PARTITION BY LinkRef ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    on = "PARTITION BY LinkRef ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return [
        ("om", "SELECT LinkRef, median(LinkTravelTime) AS median FROM obs WHERE LinkTravelTime IS NOT NULL GROUP BY LinkRef"),
        ("band", """SELECT o.LinkRef, greatest(any_value(om.median) - 3.0 * 1.4826 * median(abs(o.LinkTravelTime - om.median)), 0.0) AS low,
                any_value(om.median) + 3.0 * 1.4826 * median(abs(o.LinkTravelTime - om.median)) AS upr
            FROM obs o JOIN om USING (LinkRef) WHERE o.LinkTravelTime IS NOT NULL GROUP BY o.LinkRef"""),
        ("inl", f"SELECT o.*, {SLOT_SQL} AS slot FROM obs o JOIN band USING (LinkRef) WHERE LinkTravelTime > low AND LinkTravelTime < upr"),
        ("sm", "SELECT LinkRef, slot, avg(LinkTravelTime) AS mean FROM inl GROUP BY LinkRef, slot"),
        ("wk", """SELECT band.LinkRef, CAST(g.s AS INTEGER) AS slot, mean FROM band CROSS JOIN generate_series(0, 671) g(s)
            LEFT JOIN sm ON sm.LinkRef = band.LinkRef AND sm.slot = g.s"""),
        ("ends", f"""SELECT LinkRef, slot, mean, last_value(mean IGNORE NULLS) OVER ({up}) AS pv, first_value(mean IGNORE NULLS) OVER ({on}) AS nv,
                last_value(CASE WHEN mean IS NOT NULL THEN slot END IGNORE NULLS) OVER ({up}) AS ps,
                first_value(CASE WHEN mean IS NOT NULL THEN slot END IGNORE NULLS) OVER ({on}) AS ns FROM wk"""),
        ("line", """SELECT LinkRef, slot, CASE WHEN mean IS NOT NULL THEN mean
                ELSE pv + (nv - pv) * CAST(slot - ps AS DOUBLE) / CAST(ns - ps AS DOUBLE) END AS mean FROM ends"""),
        ("smooth", """SELECT LinkRef, slot, CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END AS mean FROM line
            WINDOW w AS (PARTITION BY LinkRef ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""),
        ("prof", f"""SELECT LinkRef, slot, coalesce(last_value(mean IGNORE NULLS) OVER ({up}), first_value(mean IGNORE NULLS) OVER ({on})) AS mean FROM smooth"""),
        ("lscale", "SELECT LinkRef, 1.0::DOUBLE AS scale FROM band"),
        ("inside", "SELECT o.* FROM obs o JOIN band USING (LinkRef) WHERE LinkTravelTime > low AND LinkTravelTime < upr"),
    ]


@query("older_profile", with_views("SELECT LinkRef, slot, round(mean, 6) AS mean FROM prof", "obs", extra=_older_ctes()))
def q_older_profile(spark, sf_dir):
    """Slot means of the older fit: one band per link, smoothed over seven slots."""
    return pr.fit_link_profile(obs(spark, sf_dir)).slots.select("LinkRef", "slot", round_half_away("mean", 6).alias("mean"))


@query("older_series", with_views("""
    SELECT LinkRef, bin_ts, round(z, 4) AS z, round(mean, 4) AS mean, scale, weight FROM zs""", "obs",
    extra=_older_ctes() + transform_ctes("inside", "", "zs")))
def q_older_series(spark, sf_dir):
    """The older transform: outliers left out inside it, unit scale (z in seconds)."""
    o = obs(spark, sf_dir)
    series = se.transform(o, pr.fit_link_profile(o), inside=True)
    return series.select("LinkRef", "bin_ts", r4("z"), r4("mean"), "scale", "weight")


# ---------------------------------------------------- fitted model in the comparison

def _lag_model(spark, sf_dir):
    """First-horizon forecasts ``(LinkRef, bin_ts, seconds)`` of the test part by the train part's lag model."""
    train, test = _split(spark, sf_dir)
    profile = pr.fit_profile(train)
    rolled = [wn.roll(se.transform(part, profile), LAGS, PREDS) for part in (train, test)]
    scored = models.lag_regression(*rolled, PREDS).where("horizon = 1")
    return scored.select("LinkRef", "bin_ts", (F.col("z_pred") * F.col("scale") + F.col("mean")).alias("seconds"))


def _numbered(src: str) -> str:
    return f"""SELECT 0 AS fold, LinkRef, bin_ts, z, mean, scale, weight, row_number() OVER (PARTITION BY LinkRef ORDER BY bin_ts) - 1 AS t,
                      count(*) OVER (PARTITION BY LinkRef) AS n_bins FROM {src}"""


_MODEL_CTES = [*forecast_ctes(), *transform_ctes("train", "tr_", "trz"), ("mtrain", _numbered("trz")), ("mtest", _numbered("hz")),
               *product_ctes("mtrain"), *solved_ctes("mtest"),
               ("lagged_model", "SELECT LinkRef, bin_ts, model AS seconds FROM seconds WHERE horizon = 1")]


@query("lag_model_series", recursive(with_views(
    "SELECT LinkRef, bin_ts, round(seconds, 3) AS seconds FROM lagged_model", "obs", "forecast_log", "external_log", extra=_MODEL_CTES)))
def q_lag_model_series(spark, sf_dir):
    return _lag_model(spark, sf_dir).select("LinkRef", "bin_ts", round_half_away("seconds", 3).alias("seconds"))


_COMPARED = [*COMPARISON_CTES, ("cmp_all", f"""SELECT * FROM cmp UNION ALL
    SELECT tt.bin_ts, tt.Day, 'lag_model' AS model, tt.truth, p.total AS pred FROM tt LEFT JOIN ({_totals_sql('lagged_model')}) p USING (bin_ts)""")]


@query("scoreboard_with_model", recursive(with_views(f"""
    SELECT subset, model, {_metrics_sql('truth', 'pred')}
    FROM ({' UNION ALL '.join(f"SELECT '{k}' AS subset, * FROM cmp_all WHERE {v}" for k, v in _SUBSET_SQL.items())})
    GROUP BY subset, model""", "obs", "forecast_log", "external_log", extra=_MODEL_CTES + _COMPARED)))
def q_scoreboard_with_model(spark, sf_dir):
    """The comparison of all forecasts, the fitted lag model among them."""
    compared = sc.comparison_frame(_truth(spark, sf_dir), {**_models(spark, sf_dir), "lag_model": _lag_model(spark, sf_dir)})
    return _round_metrics(sc.scoreboard(compared))


# ------------------------------------------------------------------------ export

@query("forecast_export", _forecast_sql("""
    SELECT 'lag_model' AS model, CAST(fold AS INTEGER) AS fold, LinkRef, bin_ts, round(model, 3) AS seconds FROM seconds WHERE horizon = 1"""))
def q_forecast_export(spark, sf_dir):
    """First-horizon forecasts of every fold, exported by model and fold and read back."""
    scored = _fold_forecasts(spark, sf_dir).where("horizon = 1").select(
        F.lit("lag_model").alias("model"), "fold", "LinkRef", "bin_ts", round_half_away("model", 3).alias("seconds"))
    path = scratch_table_path(spark, "forecasts")
    write_forecast(scored, path)
    return spark.read.parquet(path).select("model", F.col("fold").cast("int").alias("fold"), "LinkRef", "bin_ts", "seconds")


@query("checked_profile", profile_sql(FILLED_SQL))
def q_checked_profile(spark, sf_dir):
    """The filled profile, written by a job that fails if a link of the dimension or a slot is missing."""
    tables = Tables(spark, sf_dir)
    links = link_dimension(tables.raw("events")).count()
    return pr.fit_profile(tables.obs(), links=links).slots.select("LinkRef", "slot", "DowTimeRef", "mean", "low", "upr")


# ----------------------------------------------------------------- small studies

@query("fold_sizes", with_views(f"""
    , bnd AS (SELECT fold, n,
         CAST(floor((CAST({BOOTSTRAP} AS DOUBLE) + fold * CAST({STEP} AS DOUBLE)) * CAST(n AS DOUBLE)) AS BIGINT) AS a,
         CAST(floor((CAST({BOOTSTRAP} AS DOUBLE) + (fold + 1) * CAST({STEP} AS DOUBLE)) * CAST(n AS DOUBLE)) AS BIGINT) AS b
       FROM (SELECT DISTINCT n FROM rn), generate_series(0, {FOLDS - 1}) g(fold))
    SELECT CAST(fold AS INTEGER) AS fold, a AS n_train, b - a AS n_test, round(100.0 * a / n, 4) AS train_share,
           round(100.0 * (b - a) / n, 4) AS test_share FROM bnd""", "obs", extra=[_RN_CTE]))
def q_fold_sizes(spark, sf_dir):
    """Rows of the train and test part of every fold, and their shares of all rows in percent."""
    sizes = sp.tag_folds(obs(spark, sf_dir), BOOTSTRAP, STEP, FOLDS, ORDER).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "segment-sizes")
    train = fd.training(sizes, FOLDS).groupBy("fold").agg(F.sum("n").alias("n_train"))
    test = sizes.where(F.col("segment").between(0, FOLDS - 1)).select(F.col("segment").alias("fold"), F.col("n").alias("n_test"))
    both = train.join(test, "fold").withColumn("n", sizes.agg(F.sum("n")).scalar())
    return both.select(F.col("fold").cast("int").alias("fold"), "n_train", "n_test", r4(100.0 * F.col("n_train") / F.col("n"), "train_share"),
                       r4(100.0 * F.col("n_test") / F.col("n"), "test_share"))


STUDY_FROM, STUDY_TO, STUDY_LINK = "2024-01-09 06:00:00", "2024-01-10 22:00:00", "view"


def link_time_range(rows, link: str, time_from: str, time_to: str, tod=("06:00", "22:00"), weekdays: bool = True):
    """Rows of one link in ``[time_from, time_to)``, within the time of day, on weekdays if asked."""
    t = F.col("DateTime")
    kept = rows.where((F.col("LinkRef") == link) & (t >= F.lit(time_from).cast("timestamp_ntz")) & (t < F.lit(time_to).cast("timestamp_ntz")))
    kept = kept.where(time_of_day_between("DateTime", *tod))
    return kept.where(~day_name("DateTime").isin("Saturday", "Sunday")) if weekdays else kept


@query("link_time_range", with_views(f"""
    SELECT JourneyLinkRef, DateTime, LinkTravelTime FROM obs
    WHERE LinkRef = '{STUDY_LINK}' AND DateTime >= TIMESTAMP '{STUDY_FROM}' AND DateTime < TIMESTAMP '{STUDY_TO}'
      AND CAST(DateTime AS TIME) BETWEEN TIME '06:00:00' AND TIME '22:00:00' AND isodow(DateTime) < 6""", "obs"))
def q_link_time_range(spark, sf_dir):
    """One link's observations in a range of time, as the study of bin widths takes them."""
    return link_time_range(obs(spark, sf_dir), STUDY_LINK, STUDY_FROM, STUDY_TO).select("JourneyLinkRef", "DateTime", "LinkTravelTime")


@query("reference_time_keys", with_views("""
    SELECT JourneyLinkRef, make_timestamp(2007, 1, DayOfWeek, hour(DateTime), (minute(DateTime) // 15) * 15, 0) AS DateTimeReference FROM obs""", "obs"))
def q_reference_time_keys(spark, sf_dir):
    """The older slot key: a day of the first week of 2007."""
    return obs(spark, sf_dir).select("JourneyLinkRef", reference_timestamp("DayOfWeek", "DateTime").alias("DateTimeReference"))
