"""Registered queries: time keys, link statistics, robust seasonal profile, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import fixed_mean, sql_fixed_mean
from ..functions.time import floor_time, slot_of_week, slot_timestamp
from ..operators import outliers as ol
from ..operators import profile as pr
from ..operators.robust import median_mad, mad_bounds
from ..sources.adapters import Tables, with_views
from .registry import query, r4

SLOT_SQL = "CAST((DayOfWeek - 1) * 96 + (hour(DateTime) * 60 + minute(DateTime)) // 15 AS INTEGER)"



def _interp_sql(col: str, order: str = "slot") -> str:
    w_up = f"PARTITION BY LinkRef ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w_on = f"PARTITION BY LinkRef ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    pv = f"last_value({col} IGNORE NULLS) OVER ({w_up})"
    pi = f"last_value(CASE WHEN {col} IS NOT NULL THEN {order} END IGNORE NULLS) OVER ({w_up})"
    nv = f"first_value({col} IGNORE NULLS) OVER ({w_on})"
    ni = f"first_value(CASE WHEN {col} IS NOT NULL THEN {order} END IGNORE NULLS) OVER ({w_on})"
    interp = (f"{pv} + (({nv}) - ({pv})) * CAST({order} - ({pi}) AS DOUBLE) "
              f"/ NULLIF(CAST(({ni}) - ({pi}) AS DOUBLE), 0)")
    return f"coalesce({col}, {interp}, {pv}, {nv})"


def profile_ctes(source: str = "obs", p: str = "") -> list[tuple[str, str]]:
    """DuckDB CTEs of the robust profile fitted on ``source``, names prefixed by ``p``.

    ``{p}cell`` observed cells, ``{p}lscale`` per-link scale, ``{p}prof`` filled profile.
    """
    return [
        (f"{p}x", f"SELECT LinkRef, {SLOT_SQL} AS slot, LinkTravelTime AS v FROM {source} "
                  "WHERE LinkTravelTime IS NOT NULL"),
        (f"{p}med", f"SELECT LinkRef, slot, count(*) AS n, median(v) AS median FROM {p}x GROUP BY LinkRef, slot"),
        (f"{p}mad", f"""SELECT x.LinkRef, x.slot, median(abs(x.v - m.median)) * 1.4826 AS mad
               FROM {p}x x JOIN {p}med m USING (LinkRef, slot) GROUP BY x.LinkRef, x.slot"""),
        (f"{p}bounds", f"""SELECT m.LinkRef, m.slot, m.n, m.median, d.mad,
                         m.median - 3.0 * d.mad AS low, m.median + 3.0 * d.mad AS upr
                  FROM {p}med m JOIN {p}mad d USING (LinkRef, slot)"""),
        (f"{p}cell", f"""SELECT b.LinkRef, b.slot, b.n, b.median, b.mad, b.low, b.upr,
                       count(CASE WHEN x.v > b.low AND x.v < b.upr THEN 1 END) AS n_inliers,
                       {sql_fixed_mean("CASE WHEN x.v > b.low AND x.v < b.upr THEN x.v END")} AS mean
                FROM {p}bounds b JOIN {p}x x USING (LinkRef, slot)
                GROUP BY b.LinkRef, b.slot, b.n, b.median, b.mad, b.low, b.upr"""),
        (f"{p}lscale", f"""SELECT x.LinkRef, count(*) AS n_inliers, stddev_samp(x.v) AS scale
                 FROM {p}x x JOIN {p}bounds b USING (LinkRef, slot)
                 WHERE x.v > b.low AND x.v < b.upr GROUP BY x.LinkRef"""),
        (f"{p}links", f"SELECT DISTINCT LinkRef FROM {p}x"),
        (f"{p}spine", f"SELECT l.LinkRef, CAST(s AS INTEGER) AS slot FROM {p}links l, generate_series(0, 671) g(s)"),
        (f"{p}cells", f"""SELECT sp.LinkRef, sp.slot, c.mean, c.low, c.upr
                 FROM {p}spine sp LEFT JOIN {p}cell c USING (LinkRef, slot)"""),
        (f"{p}prof", f"""SELECT LinkRef, slot, {_interp_sql('mean')} AS mean, {_interp_sql('low')} AS low,
                   {_interp_sql('upr')} AS upr FROM {p}cells"""),
    ]


FILLED_SQL = """
    SELECT LinkRef, slot, TIMESTAMP '1970-01-01' + to_seconds(slot * 900) AS DowTimeRef,
           mean, low, upr FROM prof"""


def profile_sql(select: str, pre=(), post=(), views=("obs",), source: str = "obs",
                prefix: str = "") -> str:
    """SQL with adapter views, ``pre`` CTEs, the profile CTEs on ``source``, ``post`` CTEs."""
    return with_views(select, *views, extra=list(pre) + profile_ctes(source, prefix) + list(post))


def obs(spark, sf_dir):
    return Tables(spark, sf_dir).obs()


@query("time_keys", with_views(f"""
    SELECT JourneyLinkRef, LinkRef, DateTime,
           time_bucket(INTERVAL '15 minutes', DateTime) AS DateTimeRef, {SLOT_SQL} AS slot
    FROM obs""", "obs"))
def q_time_keys(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.select("JourneyLinkRef", "LinkRef", "DateTime",
                    floor_time("DateTime", "15min").alias("DateTimeRef"),
                    slot_of_week("DayOfWeek", "DateTime", "15min").alias("slot"))


@query("link_stats", with_views(f"""
    SELECT LineDirectionLinkOrder, LinkRef, LinkName, count(LinkTravelTime) AS n,
           {sql_fixed_mean("LinkTravelTime")} AS mean, round(stddev_samp(LinkTravelTime), 4) AS std
    FROM obs GROUP BY LineDirectionLinkOrder, LinkRef, LinkName""", "obs"))
def q_link_stats(spark, sf_dir):
    o = Tables(spark, sf_dir).ordered_obs()
    return o.groupBy("LineDirectionLinkOrder", "LinkRef", "LinkName").agg(
        F.count("LinkTravelTime").alias("n"),
        fixed_mean("LinkTravelTime").alias("mean"), r4(F.stddev_samp("LinkTravelTime"), "std"))


@query("seasonal_median_mad", profile_sql("SELECT LinkRef, slot, n, median, mad FROM bounds"))
def q_seasonal_median_mad(spark, sf_dir):
    o = pr.with_time_keys(obs(spark, sf_dir))
    s = median_mad(o, ["LinkRef", "slot"], "LinkTravelTime")
    return s.select("LinkRef", "slot", "n", "median", "mad")


@query("seasonal_profile", profile_sql("""
    SELECT LinkRef, slot, n, median, mad, low, upr, n_inliers, mean FROM cell"""))
def q_seasonal_profile(spark, sf_dir):
    s = pr.slot_statistics(obs(spark, sf_dir))
    return s.select("LinkRef", "slot", "n", "median", "mad", "low", "upr", "n_inliers", "mean")


@query("seasonal_profile_filled", profile_sql(FILLED_SQL))
def q_seasonal_profile_filled(spark, sf_dir):
    p = pr.fit_profile(obs(spark, sf_dir))
    return p.slots.select("LinkRef", "slot", "DowTimeRef", "mean", "low", "upr")


@query("link_scale", profile_sql("SELECT LinkRef, n_inliers, round(scale, 4) AS scale FROM lscale"))
def q_link_scale(spark, sf_dir):
    p = pr.fit_profile(obs(spark, sf_dir))
    return p.scales.select("LinkRef", "n_inliers", r4("scale"))


@query("link_mad_bounds", with_views("""
    , m AS (SELECT LinkRef, median(LinkTravelTime) AS median FROM obs
            WHERE LinkTravelTime IS NOT NULL GROUP BY LinkRef),
    d AS (SELECT o.LinkRef, median(abs(o.LinkTravelTime - m.median)) * 1.4826 AS mad
          FROM obs o JOIN m USING (LinkRef) WHERE o.LinkTravelTime IS NOT NULL GROUP BY o.LinkRef)
    SELECT LinkRef, median, mad, greatest(median - 4.0 * mad, 0.0) AS low, median + 4.0 * mad AS upr
    FROM m JOIN d USING (LinkRef)""", "obs"))
def q_link_mad_bounds(spark, sf_dir):
    b = ol.link_mad_bounds(obs(spark, sf_dir), k=4.0)
    return b.select("LinkRef", "median", "mad", "low", "upr")
