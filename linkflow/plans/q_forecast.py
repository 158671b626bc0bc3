"""Registered queries: forecasts, lead-time buckets, comparison frame and score boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import sql_fixed_mean, sql_fixed_sum
from ..functions.time import lead_time_bucket, minutes_between
from ..operators import splits as sp
from ..sources.adapters import Tables, with_views
from . import forecast as fc
from . import scoring as sc
from .periods import PERIODS, Periods
from .q_profile import _interp_sql, profile_ctes
from .q_series import transform_ctes
from .registry import query, r4

MODELS = ("historical_average", "incumbent", "external")


def _split(spark, sf_dir, periods: Periods = PERIODS):
    return sp.date_split(Tables(spark, sf_dir).obs(), "DateTime", periods.train_before, periods.test_from, periods.test_before)


def _truth(spark, sf_dir, periods: Periods = PERIODS):
    _, test = _split(spark, sf_dir, periods)
    return fc.ground_truth(test)


def _models(spark, sf_dir, periods: Periods = PERIODS):
    t = Tables(spark, sf_dir)
    train, test = _split(spark, sf_dir, periods)
    return {"historical_average": fc.historical_average(train, test),
            "incumbent": fc.incumbent_series(t.forecast_log(), "15min"),
            "external": fc.external_series(t.external_log())}


# ----------------------------------------------------------------- SQL pieces

SPLIT_CTES = [
    ("train", f"SELECT * FROM obs WHERE DateTime < TIMESTAMP '{PERIODS.train_before}'"),
    ("test", f"SELECT * FROM obs WHERE DateTime >= TIMESTAMP '{PERIODS.test_from}' "
             f"AND DateTime < TIMESTAMP '{PERIODS.test_before}'"),
]
LEAD_SQL = ("CAST(date_diff('microsecond', LogTime, EstimatedDepartureDateTime) AS DOUBLE) "
            "/ CAST(60000000 AS DOUBLE)")
BUCKET_SQL = (f"CASE WHEN {LEAD_SQL} >= 45 THEN '45min+' WHEN {LEAD_SQL} >= 30 THEN '45min' "
              f"WHEN {LEAD_SQL} >= 15 THEN '30min' WHEN {LEAD_SQL} >= 0 THEN '15min' END")


def resample_filled_ctes(src: str, ts: str, value: str, out: str) -> list[tuple[str, str]]:
    """DuckDB: per-link 15-min means on the union spine, interpolate -> pad -> bfill."""
    return [
        (f"{out}_b", f"""SELECT LinkRef, time_bucket(INTERVAL '15 minutes', {ts}) AS bin_ts,
                {sql_fixed_mean(value)} AS v FROM {src} GROUP BY LinkRef, bin_ts"""),
        (f"{out}_sp", f"SELECT LinkRef, min(bin_ts) f, max(bin_ts) l FROM {out}_b GROUP BY LinkRef"),
        (f"{out}_cov", f"""SELECT DISTINCT unnest(generate_series(f, l, INTERVAL '15 minutes')) AS bin_ts
                FROM {out}_sp"""),
        (f"{out}_c", f"""SELECT s.LinkRef, c.bin_ts, b.v,
                row_number() OVER (PARTITION BY s.LinkRef ORDER BY c.bin_ts) AS pos
            FROM {out}_sp s CROSS JOIN {out}_cov c
            LEFT JOIN {out}_b b ON b.LinkRef = s.LinkRef AND b.bin_ts = c.bin_ts"""),
        (out, f"SELECT LinkRef, bin_ts, {_interp_sql('v', 'pos')} AS seconds FROM {out}_c"),
    ]


def forecast_ctes() -> list[tuple[str, str]]:
    return (SPLIT_CTES
            + profile_ctes("test", "te_") + transform_ctes("test", "te_", "tz")
            + [("truth", "SELECT LinkRef, bin_ts, CASE WHEN scale IS NOT NULL THEN dev + mean END "
                         "AS seconds FROM tz")]
            + profile_ctes("train", "tr_") + transform_ctes("test", "tr_", "hz")
            + [("ha", "SELECT LinkRef, bin_ts, mean AS seconds FROM hz"),
               ("fl", f"SELECT *, {BUCKET_SQL} AS Prediction FROM forecast_log")]
            + resample_filled_ctes("(SELECT * FROM fl WHERE Prediction = '15min')", "LogTime",
                                   "EstimatedLinkTravelTime", "inc")
            + resample_filled_ctes("external_log", "LogTime", "Duration", "ext"))


def forecast_sql(select: str, post=()) -> str:
    return with_views(select, "obs", "forecast_log", "external_log",
                      extra=forecast_ctes() + list(post))


def _tod_sql(col: str, a: str, b: str) -> str:
    def secs(hhmm):
        h, m = hhmm.split(":")
        return int(h) * 3600 + int(m) * 60
    tod = f"(hour({col}) * 3600 + minute({col}) * 60 + second({col}))"
    return f"({tod} >= {secs(a)} AND {tod} <= {secs(b)})"


def _metrics_sql(t: str, p: str) -> str:
    both = f"{t} IS NOT NULL AND {p} IS NOT NULL"
    ae = f"CASE WHEN {both} THEN abs({t} - {p}) END"
    den = f"(abs({t}) + abs({p}))"
    return (f"round(sqrt(avg(CASE WHEN {both} THEN ({t} - {p}) * ({t} - {p}) END)), 4) AS rmse, "
            f"round(avg({ae}), 4) AS mae, "
            f"round(avg({ae} / NULLIF({t}, 0)) * 100, 4) AS mape, "
            f"round(avg({ae} / NULLIF({den}, 0) / 2) * 100, 4) AS smape, "
            f"round(avg(2 * {ae} / NULLIF({den}, 0)) * 100, 4) AS smape_std, "
            f"count(CASE WHEN {both} THEN 1 END) AS n_pairs")


def _round_metrics(df):
    keep = [c for c in df.columns if c not in ("rmse", "mae", "mape", "smape", "smape_std")]
    return df.select(*keep, *[r4(c) for c in ("rmse", "mae", "mape", "smape", "smape_std")])


def _totals_sql(src: str) -> str:
    return f"SELECT bin_ts, {sql_fixed_sum('seconds')} / 60.0 AS total FROM {src} GROUP BY bin_ts"


COMPARISON_CTES = [
    ("tt", f"""SELECT bin_ts, dayname(bin_ts) AS Day, total AS truth FROM ({_totals_sql('truth')})
               WHERE {_tod_sql('bin_ts', '06:00', '22:00')}"""),
    ("cmp", " UNION ALL ".join(
        f"""SELECT tt.bin_ts, tt.Day, '{m}' AS model, tt.truth, p.total AS pred
            FROM tt LEFT JOIN ({_totals_sql(src)}) p USING (bin_ts)"""
        for m, src in zip(MODELS, ("ha", "inc", "ext")))),
]


# -------------------------------------------------------------------- queries

@query("historical_average", forecast_sql("SELECT LinkRef, bin_ts, round(seconds, 4) AS seconds FROM ha"))
def q_historical_average(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return fc.historical_average(train, test).select("LinkRef", "bin_ts", r4("seconds"))


@query("ground_truth", forecast_sql("SELECT LinkRef, bin_ts, round(seconds, 4) AS seconds FROM truth"))
def q_ground_truth(spark, sf_dir):
    return _truth(spark, sf_dir).select("LinkRef", "bin_ts", r4("seconds"))


@query("lead_time_bucket", forecast_sql(f"""
    SELECT JourneyLinkRef, LogTime, EstimatedDepartureDateTime, round({LEAD_SQL}, 4) AS lead_min,
           Prediction FROM fl"""))
def q_lead_time_bucket(spark, sf_dir):
    log = Tables(spark, sf_dir).forecast_log()
    return log.select("JourneyLinkRef", "LogTime", "EstimatedDepartureDateTime",
                      r4(minutes_between("LogTime", "EstimatedDepartureDateTime"), "lead_min"),
                      lead_time_bucket("LogTime", "EstimatedDepartureDateTime").alias("Prediction"))


@query("lead_time_histogram", forecast_sql(f"""
    SELECT floor({LEAD_SQL}) * 1.0 AS lead_bin, count(*) AS n FROM forecast_log
    WHERE EstimatedDepartureDateTime IS NOT NULL GROUP BY lead_bin"""))
def q_lead_time_histogram(spark, sf_dir):
    h = fc.lead_time_histogram(Tables(spark, sf_dir).forecast_log(), 1.0)
    return h.select(F.col("lead_bin").cast("double").alias("lead_bin"), "n")


@query("incumbent_series", forecast_sql("SELECT LinkRef, bin_ts, round(seconds, 4) AS seconds FROM inc"))
def q_incumbent_series(spark, sf_dir):
    return fc.incumbent_series(Tables(spark, sf_dir).forecast_log(), "15min").select(
        "LinkRef", "bin_ts", r4("seconds"))


def multistep_ctes() -> list[tuple[str, str]]:
    """DuckDB: filled incumbent series per lead bucket and ``msu`` = their line totals."""
    ctes, parts = [], []
    for b in fc.LEAD_BUCKETS:
        name = "ms" + b.replace("min", "")
        ctes += resample_filled_ctes(f"(SELECT * FROM fl WHERE Prediction = '{b}')", "LogTime",
                                     "EstimatedLinkTravelTime", name)
        parts.append(f"""SELECT '{b}' AS Prediction, bin_ts, {sql_fixed_sum('seconds')}
                         AS total_seconds FROM {name} GROUP BY bin_ts""")
    return ctes + [("msu", " UNION ALL ".join(parts))]


def _multistep_sql() -> str:
    return forecast_sql("SELECT Prediction, bin_ts, round(total_seconds, 4) AS total_seconds FROM msu",
                        post=multistep_ctes())


@query("incumbent_multistep", _multistep_sql())
def q_incumbent_multistep(spark, sf_dir):
    ms = fc.incumbent_multistep(Tables(spark, sf_dir).forecast_log())
    return ms.select("Prediction", "bin_ts", r4("total_seconds"))


@query("external_series", forecast_sql("SELECT LinkRef, bin_ts, round(seconds, 4) AS seconds FROM ext"))
def q_external_series(spark, sf_dir):
    return fc.external_series(Tables(spark, sf_dir).external_log()).select(
        "LinkRef", "bin_ts", r4("seconds"))


@query("comparison_frame", forecast_sql("""
    SELECT bin_ts, Day, model, round(truth, 4) AS truth, round(pred, 4) AS pred FROM cmp""",
    post=COMPARISON_CTES))
def q_comparison_frame(spark, sf_dir):
    cmp = sc.comparison_frame(_truth(spark, sf_dir), _models(spark, sf_dir))
    return cmp.select("bin_ts", "Day", "model", r4("truth"), r4("pred"))


_SUBSET_SQL = {
    "all": "TRUE",
    "thursday": "Day = 'Thursday'",
    "friday": "Day = 'Friday'",
    "weekday_07_09": f"Day NOT IN ('Saturday', 'Sunday') AND {_tod_sql('bin_ts', '07:00', '09:00')}",
    "weekday_14_18": f"Day NOT IN ('Saturday', 'Sunday') AND {_tod_sql('bin_ts', '14:00', '18:00')}",
    "thursday_07_09": f"Day = 'Thursday' AND {_tod_sql('bin_ts', '07:00', '09:00')}",
}


@query("scoreboard", forecast_sql(f"""
    SELECT subset, model, {_metrics_sql('truth', 'pred')}
    FROM ({' UNION ALL '.join(f"SELECT '{k}' AS subset, * FROM cmp WHERE {v}" for k, v in _SUBSET_SQL.items())})
    GROUP BY subset, model""", post=COMPARISON_CTES))
def q_scoreboard(spark, sf_dir):
    cmp = sc.comparison_frame(_truth(spark, sf_dir), _models(spark, sf_dir))
    return _round_metrics(sc.scoreboard(cmp))


def _by_horizon_sql() -> str:
    th = " UNION ALL ".join(
        f"SELECT bin_ts - to_minutes({15 * (h - 1)}) AS bin_ts, {h} AS horizon, total AS truth_total "
        f"FROM (SELECT bin_ts, {sql_fixed_sum('seconds')} AS total FROM truth GROUP BY bin_ts)"
        for h in (1, 2, 3))
    ev = (f"bin_ts >= TIMESTAMP '{PERIODS.eval_from}' AND bin_ts <= TIMESTAMP '{PERIODS.eval_to}' "
          f"AND {_tod_sql('bin_ts', '06:00', '22:00')}")
    return forecast_sql(f"""
        SELECT 'incumbent' AS model, CAST(t.horizon AS INTEGER) AS horizon,
               printf('t + %d (%d min)', t.horizon, t.horizon * 15) AS time_ahead,
               {_metrics_sql('t.truth_total / 60.0', 'm.total_seconds / 60.0')}
        FROM (SELECT * FROM thz WHERE {ev}) t
        JOIN (SELECT CASE Prediction WHEN '15min' THEN 1 WHEN '30min' THEN 2 ELSE 3 END AS horizon,
                     bin_ts, total_seconds FROM msu) m
          ON m.bin_ts = t.bin_ts AND m.horizon = t.horizon
        GROUP BY t.horizon""", post=multistep_ctes() + [("thz", th)])


@query("scoreboard_by_horizon", _by_horizon_sql())
def q_scoreboard_by_horizon(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ms = fc.incumbent_multistep(t.forecast_log())
    out = sc.scoreboard_by_horizon(_truth(spark, sf_dir), ms, "incumbent", PERIODS.eval_from, PERIODS.eval_to)
    return _round_metrics(out.withColumn("horizon", F.col("horizon").cast("int")))
