"""String column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def concat_null_as_empty(*parts) -> Column:
    """T-SQL ``concat``: NULL parts count as empty text (Spark ``concat`` would return NULL).

    Plain ``str`` parts are literals (separators); columns are passed as ``Column``.
    """
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(""))
            for p in parts]
    return F.concat(*cols)


def link_key(from_col, to_col, sep: str = ":") -> Column:
    """``from + ':' + to``; missing part -> missing key (string ``+`` semantics)."""
    return F.concat(_c(from_col).cast("string"), F.lit(sep), _c(to_col).cast("string"))


def horizon_label(h, step_minutes: int = 15) -> Column:
    """'t + 1 (15 min)' for horizon 1 (1-based)."""
    hc = _c(h)
    return F.format_string("t + %d (%d min)", hc, hc * F.lit(step_minutes))


def wkt_point_xy(col) -> Column:
    """Parse 'POINT (x y)' into struct<x:double,y:double>."""
    c = _c(col)
    pat = r"^\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$"
    return F.struct(F.regexp_extract(c, pat, 1).cast("double").alias("x"),
                    F.regexp_extract(c, pat, 2).cast("double").alias("y"))


def wkt_kind(col) -> Column:
    """Upper-case geometry kind of a WKT text ('POINT', 'LINESTRING', 'MULTILINESTRING', ...)."""
    return F.upper(F.regexp_extract(_c(col), r"^\s*([A-Za-z]+)", 1))
