"""Local copy of the correctness check: a Spark result against DuckDB SQL on the same parquet."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from linkflow.sources.adapters import TABLES


def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run_oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb_connection(sf_dir)
    try:
        return con.execute(sql).df()
    finally:
        con.close()


def _normalise(df: pd.DataFrame, digits: int | None) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            df[c] = s.round(digits) if digits is not None else s
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = pd.to_datetime(s).dt.tz_localize(None) if getattr(s.dt, "tz", None) else s
            df[c] = df[c].astype("datetime64[us]")
        elif s.dtype == object:
            df[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v))
                          else (str(list(v)) if isinstance(v, (list, np.ndarray)) else v))
    df = df.astype(object).where(pd.notna(df), None)
    key = df.map(lambda v: "\x00" if v is None else repr(v))
    order = key.sort_values(list(key.columns)).index
    return df.loc[order].reset_index(drop=True)


def compare(spark_df, sql: str, sf_dir: str, digits: int | None = None) -> tuple[bool, str]:
    """(ok, message). Column names must match exactly; values exactly (or after rounding)."""
    got = spark_df.toPandas()
    exp = run_oracle(sf_dir, sql)
    return compare_frames(got, exp, digits)


def compare_frames(got: pd.DataFrame, exp: pd.DataFrame, digits: int | None = None):
    if sorted(got.columns) != sorted(exp.columns):
        return False, f"columns differ: spark={sorted(got.columns)} oracle={sorted(exp.columns)}"
    if len(got) != len(exp):
        return False, f"row count differs: spark={len(got)} oracle={len(exp)}"
    a, b = _normalise(got, digits), _normalise(exp, digits)
    for c in a.columns:
        av, bv = a[c].tolist(), b[c].tolist()
        if av != bv:
            bad = [i for i, (x, y) in enumerate(zip(av, bv)) if x != y]
            i = bad[0]
            msg = (f"column {c}: {len(bad)} differing rows, first at {i}: "
                   f"spark={av[i]!r} oracle={bv[i]!r}")
            if digits is None:
                ok6, _ = compare_frames(got, exp, 6)
                msg += " (equal after rounding to 6 places)" if ok6 else ""
            return False, msg
    return True, f"{len(got)} rows match" + ("" if digits is None else f" at {digits} places")
