"""Registered queries: resampling, transform, windows, splits, filters, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import sql_fixed_mean
from ..functions.time import day_name, iso_dow, time_of_day_between
from ..operators import outliers as ol
from ..operators import profile as pr
from ..operators import resample as rs
from ..operators import series as se
from ..operators import splits as sp
from ..operators import windows as wn
from ..session import materialize, scratch_table_path
from ..sources.adapters import Tables, link_dimension, with_views
from ..sources.readers import read_link_observations, read_wide_blocks
from ..sources.sinks import link_order, to_wide, write_wide_blocks
from .periods import PERIODS
from .q_profile import SLOT_SQL, _interp_sql, profile_sql
from .registry import query, r4

LAGS, PREDS = 32, 3
ORDER = ("DateTime", "JourneyLinkRef")


def obs(spark, sf_dir):
    return Tables(spark, sf_dir).obs()


def zseries(spark, sf_dir):
    o = obs(spark, sf_dir)
    return se.transform(o, pr.fit_profile(o))


# ------------------------------------------------------------------ resampling

def _bins_sql(src: str, value: str, secs: int, name: str = "b") -> tuple[str, str]:
    return (name, f"""SELECT LinkRef, time_bucket(to_seconds({secs}), DateTime) AS bin_ts,
                         {sql_fixed_mean(value)} AS v, count({value}) AS n
                  FROM {src} GROUP BY LinkRef, bin_ts""")


def _own_spine_sql(bins: str, secs: int, name: str) -> tuple[str, str]:
    return (name, f"""SELECT LinkRef, unnest(generate_series(f, l, to_seconds({secs}))) AS bin_ts
                  FROM (SELECT LinkRef, min(bin_ts) f, max(bin_ts) l FROM {bins} GROUP BY LinkRef)""")


@query("resample_mean_count", with_views("""
    SELECT s.LinkRef, s.bin_ts, b.v AS LinkTravelTime, coalesce(b.n, 0) AS n
    FROM spine s LEFT JOIN b USING (LinkRef, bin_ts)""", "obs",
    extra=[_bins_sql("obs", "LinkTravelTime", 900), _own_spine_sql("b", 900, "spine")]))
def q_resample_mean_count(spark, sf_dir):
    return rs.resample_mean_count(obs(spark, sf_dir))


def _multi_res_sql() -> str:
    ctes, parts = [], []
    for secs, label in ((300, "5min"), (900, "15min"), (1800, "30min")):
        ctes += [_bins_sql("obs", "LinkTravelTime", secs, f"b{secs}"),
                 _own_spine_sql(f"b{secs}", secs, f"s{secs}"),
                 (f"c{secs}", f"""SELECT s.LinkRef, s.bin_ts, b.v,
                        row_number() OVER (PARTITION BY s.LinkRef ORDER BY s.bin_ts) AS pos
                    FROM s{secs} s LEFT JOIN b{secs} b USING (LinkRef, bin_ts)""")]
        interp = _interp_sql("v", "pos")
        # linear interpolation then pad only (no back-fill of a leading gap)
        no_bfill = interp[: interp.rindex(", first_value")] + ")"
        parts.append(f"SELECT '{label}' AS freq, LinkRef, bin_ts, {no_bfill} AS LinkTravelTime FROM c{secs}")
    return with_views(" UNION ALL ".join(parts), "obs", extra=ctes)


@query("multi_resolution", _multi_res_sql())
def q_multi_resolution(spark, sf_dir):
    return rs.multi_resolution(obs(spark, sf_dir), "LinkRef", "DateTime", "LinkTravelTime",
                               then_bfill=False).select("freq", "LinkRef", "bin_ts", "LinkTravelTime")


# ------------------------------------------------------------------- transform

def transform_ctes(src: str, p: str, out: str) -> list[tuple[str, str]]:
    """DuckDB: transform of ``src`` with the profile prefixed ``p`` -> CTE ``out``."""
    return [
        (f"{out}_lk", f"""SELECT o.LinkRef, time_bucket(INTERVAL '15 minutes', o.DateTime) AS bin_ts,
                o.LinkTravelTime, pf.mean AS pmean
            FROM {src} o LEFT JOIN {p}prof pf ON pf.LinkRef = o.LinkRef AND pf.slot = {SLOT_SQL.replace('DayOfWeek', 'o.DayOfWeek').replace('DateTime', 'o.DateTime')}"""),
        (f"{out}_b", f"""SELECT LinkRef, bin_ts, {sql_fixed_mean('LinkTravelTime')} AS x,
                {sql_fixed_mean('pmean')} AS m, count(LinkTravelTime) AS w
            FROM {out}_lk GROUP BY LinkRef, bin_ts"""),
        (f"{out}_sp", f"SELECT LinkRef, min(bin_ts) f, max(bin_ts) l FROM {out}_b GROUP BY LinkRef"),
        (f"{out}_cov", f"""SELECT DISTINCT unnest(generate_series(f, l, INTERVAL '15 minutes')) AS bin_ts
            FROM {out}_sp"""),
        (f"{out}_c", f"""SELECT s.LinkRef, c.bin_ts, b.x, b.m, b.w, sc.scale,
                (b.x - b.m) / NULLIF(sc.scale, 0) AS z0,
                CASE WHEN sc.scale IS NOT NULL THEN b.x - b.m END AS d0
            FROM {out}_sp s CROSS JOIN {out}_cov c
            LEFT JOIN {out}_b b ON b.LinkRef = s.LinkRef AND b.bin_ts = c.bin_ts
            LEFT JOIN {p}lscale sc ON sc.LinkRef = s.LinkRef"""),
        (out, f"""SELECT LinkRef, bin_ts,
                coalesce(last_value(z0 IGNORE NULLS) OVER wu, 0.0) AS z,
                coalesce(last_value(d0 IGNORE NULLS) OVER wu, 0.0) AS dev,
                coalesce(last_value(m IGNORE NULLS) OVER wu, first_value(m IGNORE NULLS) OVER wo) AS mean,
                scale, coalesce(w, 0) AS weight, x
            FROM {out}_c
            WINDOW wu AS (PARTITION BY LinkRef ORDER BY bin_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   wo AS (PARTITION BY LinkRef ORDER BY bin_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    ]


def zseries_sql(select: str, post=()) -> str:
    return profile_sql(select, post=transform_ctes("obs", "", "zs") + list(post))


@query("zscore_series", zseries_sql("""
    SELECT LinkRef, bin_ts, round(z, 4) AS z, mean, round(scale, 4) AS scale, weight, x FROM zs"""))
def q_zscore_series(spark, sf_dir):
    return zseries(spark, sf_dir).select("LinkRef", "bin_ts", r4("z"), "mean", r4("scale"),
                                         "weight", "x")


@query("inverse_series", zseries_sql("""
    SELECT LinkRef, bin_ts, round(CASE WHEN scale IS NOT NULL THEN dev + mean END, 4) AS seconds FROM zs"""))
def q_inverse_series(spark, sf_dir):
    return se.inverse(zseries(spark, sf_dir)).select("LinkRef", "bin_ts", r4("seconds"))


EVENT_LINKS = ("click", "error", "purchase", "signup", "view")   # columns that the oracle expects


@query("wide_series", zseries_sql("SELECT bin_ts, " + ", ".join(
    f"max(CASE WHEN LinkRef = '{link}' AND scale IS NOT NULL THEN round(dev + mean, 4) END) AS \"{link}\""
    for link in EVENT_LINKS) + " FROM zs GROUP BY bin_ts"))
def q_wide_series(spark, sf_dir):
    """One column per link of the link dimension, in display order."""
    long = se.inverse(zseries(spark, sf_dir)).select("LinkRef", "bin_ts", r4("seconds"))
    links = link_order(materialize(link_dimension(Tables(spark, sf_dir).raw("events")), "links")).orderBy("link_index").collect()
    return to_wide(long, "bin_ts", "LinkRef", "seconds", [r.LinkRef for r in links])


@query("wide_blocks", zseries_sql("""
    SELECT LinkRef, bin_ts, round(CASE WHEN scale IS NOT NULL THEN dev + mean END, 4) AS seconds FROM zs
    WHERE scale IS NOT NULL"""))
def q_wide_blocks(spark, sf_dir):
    """The series written wide, in blocks of two links by display order, and read back."""
    long = se.inverse(zseries(spark, sf_dir)).select("LinkRef", "bin_ts", r4("seconds"))
    path = scratch_table_path(spark, "wide")
    write_wide_blocks(long, path, link_order(link_dimension(Tables(spark, sf_dir).raw("events"))), width=2)
    return read_wide_blocks(spark, path).select("LinkRef", "bin_ts", "seconds")


@query("link_order", with_views("SELECT LinkRef, LineDirectionLinkOrder AS link_index FROM obs_links", "obs"))
def q_link_order(spark, sf_dir):
    """Links in display order, from the observations' link orders."""
    return link_order(Tables(spark, sf_dir).ordered_obs()).select("LinkRef", F.col("link_index").cast("int").alias("link_index"))


@query("observations_from_csv", with_views("""
    SELECT JourneyLinkRef, JourneyRef, DateTime, LineDirectionCode, LineDirectionLinkOrder, LinkRef, LinkName, DayOfWeek, LinkTravelTime
    FROM obs""", "obs"))
def q_observations_from_csv(spark, sf_dir):
    """The extraction's file format: ';' CSV with a header, written and read with its declared schema."""
    path = scratch_table_path(spark, "observations")
    Tables(spark, sf_dir).ordered_obs().write.option("header", True).option("sep", ";").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return read_link_observations(spark, path)


# --------------------------------------------------------------------- windows

_POS_CTE = ("pos", """SELECT *, row_number() OVER (PARTITION BY LinkRef ORDER BY bin_ts) - 1 AS t,
                        count(*) OVER (PARTITION BY LinkRef) AS n_bins FROM zs""")


@query("lag_windows", zseries_sql(f"""
    SELECT a.LinkRef, a.bin_ts, a.t, CAST(k AS INTEGER) AS lag, round(b.z, 4) AS value
    FROM pos a, generate_series(1, {LAGS}) g(k), pos b
    WHERE a.t >= {LAGS} AND a.t < a.n_bins - {PREDS} AND b.LinkRef = a.LinkRef AND b.t = a.t - k""",
    post=[_POS_CTE]))
def q_lag_windows(spark, sf_dir):
    rolled = wn.roll(zseries(spark, sf_dir), LAGS, PREDS)
    return wn.explode_lags(rolled).select("LinkRef", "bin_ts", F.col("t").cast("long").alias("t"),
                                          "lag", r4("value"))


@query("horizon_windows", zseries_sql(f"""
    SELECT a.LinkRef, a.bin_ts, a.t, CAST(k AS INTEGER) AS horizon, round(b.z, 4) AS z, b.mean,
           round(b.scale, 4) AS scale, b.weight
    FROM pos a, generate_series(1, {PREDS}) g(k), pos b
    WHERE a.t >= {LAGS} AND a.t < a.n_bins - {PREDS} AND b.LinkRef = a.LinkRef AND b.t = a.t + k - 1""",
    post=[_POS_CTE]))
def q_horizon_windows(spark, sf_dir):
    rolled = wn.roll(zseries(spark, sf_dir), LAGS, PREDS)
    return wn.explode_horizons(rolled).select("LinkRef", "bin_ts", F.col("t").cast("long").alias("t"),
                                              "horizon", r4("z"), "mean", r4("scale"), "weight")


# ---------------------------------------------------------------------- splits

_RN_CTE = ("rn", """SELECT *, row_number() OVER (ORDER BY DateTime, JourneyLinkRef) - 1 AS rn,
                       count(*) OVER () AS n FROM obs""")


@query("row_fraction_split", with_views("""
    SELECT CASE WHEN rn < CAST(floor(CAST(0.95 AS DOUBLE) * CAST(n AS DOUBLE)) AS BIGINT)
                THEN 'train' ELSE 'test' END AS part,
           count(*) AS n_rows, min(DateTime) AS first_ts, max(DateTime) AS last_ts
    FROM rn GROUP BY part""", "obs", extra=[_RN_CTE]))
def q_row_fraction_split(spark, sf_dir):
    o = obs(spark, sf_dir)
    train, test = sp.row_fraction_split(o, 0.95, ORDER)
    def summary(df, part):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"),
                      F.min("DateTime").alias("first_ts"), F.max("DateTime").alias("last_ts"))
    return summary(train, "train").unionByName(summary(test, "test"))


@query("expanding_folds", with_views("""
    , bnd AS (SELECT fold,
         CAST(floor((CAST(0.8 AS DOUBLE) + fold * CAST(0.05 AS DOUBLE)) * CAST(n AS DOUBLE)) AS BIGINT) AS a,
         CAST(floor((CAST(0.8 AS DOUBLE) + (fold + 1) * CAST(0.05 AS DOUBLE)) * CAST(n AS DOUBLE)) AS BIGINT) AS b
       FROM (SELECT DISTINCT n FROM rn), generate_series(0, 3) g(fold))
    SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n_rows, min(DateTime) AS first_ts,
           max(DateTime) AS last_ts
    FROM (SELECT bnd.fold, CASE WHEN rn.rn < bnd.a THEN 'train' ELSE 'test' END AS part, rn.DateTime
          FROM rn JOIN bnd ON rn.rn < bnd.b) q
    GROUP BY fold, part""", "obs", extra=[_RN_CTE]))
def q_expanding_folds(spark, sf_dir):
    tagged = sp.tag_folds(obs(spark, sf_dir), 0.80, 0.05, 4, ORDER)
    seg = tagged.groupBy("segment").agg(F.count(F.lit(1)).alias("n"),
                                        F.min("DateTime").alias("f"), F.max("DateTime").alias("l"))
    # segment s trains folds s+1 .. 3 (an empty range gives no rows)
    later = F.when(F.col("segment") + 1 <= 3, F.sequence(F.col("segment") + 1, F.lit(3)))
    train = seg.select(F.explode(later).alias("fold"),
                       F.lit("train").alias("part"), "n", "f", "l")
    test = seg.where((F.col("segment") >= 0) & (F.col("segment") <= 3)).select(
        F.col("segment").alias("fold"), F.lit("test").alias("part"), "n", "f", "l")
    return (train.unionByName(test).groupBy("fold", "part")
            .agg(F.sum("n").alias("n_rows"), F.min("f").alias("first_ts"), F.max("l").alias("last_ts"))
            .select(F.col("fold").cast("int").alias("fold"), "part", "n_rows", "first_ts", "last_ts"))


@query("date_split", with_views(f"""
    SELECT part, count(*) AS n_rows, count(DISTINCT LinkRef) AS n_links,
           min(DateTime) AS first_ts, max(DateTime) AS last_ts
    FROM (SELECT 'train' AS part, * FROM obs WHERE DateTime < TIMESTAMP '{PERIODS.train_before}'
          UNION ALL
          SELECT 'test' AS part, * FROM obs
          WHERE DateTime >= TIMESTAMP '{PERIODS.test_from}' AND DateTime < TIMESTAMP '{PERIODS.test_before}') q
    GROUP BY part""", "obs"))
def q_date_split(spark, sf_dir):
    train, test = sp.date_split(obs(spark, sf_dir), "DateTime", PERIODS.train_before, PERIODS.test_from, PERIODS.test_before)
    def summary(df, part):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"),
                      F.countDistinct("LinkRef").alias("n_links"),
                      F.min("DateTime").alias("first_ts"), F.max("DateTime").alias("last_ts"))
    return summary(train, "train").unionByName(summary(test, "test"))


# --------------------------------------------------------------------- filters

_TOD_SQL = "(hour(DateTime) * 3600 + minute(DateTime) * 60 + second(DateTime) + microsecond(DateTime) % 1000000 / 1e6)"


@query("time_of_day_filter", with_views(f"""
    SELECT JourneyLinkRef, LinkRef, DateTime FROM obs
    WHERE {_TOD_SQL} >= 6 * 3600 AND {_TOD_SQL} <= 22 * 3600""", "obs"))
def q_time_of_day_filter(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.where(time_of_day_between("DateTime", "06:00", "22:00")).select(
        "JourneyLinkRef", "LinkRef", "DateTime")


@query("day_filter", with_views("""
    SELECT dayname(DateTime) AS Day, isodow(DateTime) < 6 AS is_weekday,
           count(*) AS n_rows, count(LinkTravelTime) AS n_observed
    FROM obs WHERE dayname(DateTime) NOT IN ('Saturday', 'Sunday')
    GROUP BY Day, is_weekday""", "obs"))
def q_day_filter(spark, sf_dir):
    o = obs(spark, sf_dir).withColumn("Day", day_name("DateTime"))
    kept = o.where(~F.col("Day").isin("Saturday", "Sunday"))
    return kept.groupBy("Day", (iso_dow("DateTime") < 6).alias("is_weekday")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("LinkTravelTime").alias("n_observed"))


# -------------------------------------------------------------------- outliers

_FLAG_CTE = ("fl", f"""SELECT o.JourneyLinkRef, o.LinkRef, o.DateTime, o.LinkTravelTime, pf.slot,
        coalesce(o.LinkTravelTime > pf.low AND o.LinkTravelTime < pf.upr, false) AS inlier
    FROM obs o LEFT JOIN prof pf ON pf.LinkRef = o.LinkRef
         AND pf.slot = {SLOT_SQL.replace('DayOfWeek', 'o.DayOfWeek').replace('DateTime', 'o.DateTime')}""")


@query("remove_outliers", profile_sql("""
    SELECT JourneyLinkRef, LinkRef, DateTime, LinkTravelTime FROM fl WHERE inlier""",
    post=[_FLAG_CTE]))
def q_remove_outliers(spark, sf_dir):
    o = obs(spark, sf_dir)
    kept = ol.remove_outliers(o, pr.fit_profile(o).slots)
    return kept.select("JourneyLinkRef", "LinkRef", "DateTime", "LinkTravelTime")


@query("outlier_report", profile_sql("""
    SELECT count(*) AS rows, count(*) FILTER (WHERE NOT inlier) AS removed,
           count(*) FILTER (WHERE LinkTravelTime IS NULL) AS removed_missing,
           round(count(*) FILTER (WHERE NOT inlier) * 100.0 / count(*), 4) AS removed_share
    FROM fl""", post=[_FLAG_CTE]))
def q_outlier_report(spark, sf_dir):
    o = obs(spark, sf_dir)
    rep = ol.outlier_report(o, pr.fit_profile(o).slots)
    return rep.select("rows", "removed", "removed_missing", r4("removed_share"))


@query("fixed_band", with_views("""
    SELECT JourneyLinkRef, LinkRef, LinkTravelTime FROM obs
    WHERE LinkTravelTime > 0 AND LinkTravelTime < 1000""", "obs"))
def q_fixed_band(spark, sf_dir):
    return ol.fixed_band(obs(spark, sf_dir), 0.0, 1000.0).select(
        "JourneyLinkRef", "LinkRef", "LinkTravelTime")
