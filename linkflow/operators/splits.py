"""Dataset splits: by date, by row fraction in time order, expanding-window folds.

Row-fraction splits need the row at a global position in (time, tie) order. Rows are counted
per hour; the running sum over that small table names the hour that holds a position, and
counts per minute and second inside that hour narrow it to one second, whose rows alone are
sorted. No global sort, no copy of the data, no assumption about files or partitions. The
split itself is a key-range predicate on the original rows. A NULL time (or tie) sorts last,
so every row is in exactly one part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


UNITS = ("hour", "minute", "second")


def _key_less(cols: Sequence[str], bound: Sequence) -> Column:
    """Lexicographic ``(cols) < (bound)``, NULL being larger than any value."""
    cond = None
    for i in range(len(cols) - 1, -1, -1):
        c, b = F.col(cols[i]), bound[i]
        if b is None:                     # only a value is below NULL
            less, same = c.isNotNull(), c.isNull()
        else:
            less, same = F.coalesce(c < F.lit(b), F.lit(False)), F.coalesce(c == F.lit(b), F.lit(False))
        cond = less if cond is None else less | (same & cond)
    return cond


def time_counts(df: DataFrame, time: str, unit: str = "hour") -> list[tuple]:
    """[(start of the hour, rows)] in time order, NULL last; as many entries as hours covered."""
    rows = (df.groupBy(F.date_trunc(unit, F.col(time)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.asc_nulls_last("at")).collect())
    return [(r["at"], r["n"]) for r in rows]


def _holding(counts: list[tuple], position: int):
    """(bucket, position inside it) of a position."""
    for at, n in counts:
        if position < n:
            return at, position
        position -= n
    raise IndexError(position)


def _start(at, unit: str):
    """``date_trunc`` of a collected time."""
    return at.replace(microsecond=0, second=0 if unit != "second" else at.second, minute=0 if unit == "hour" else at.minute)


def _within(df: DataFrame, time: str, unit: str, starts) -> DataFrame:
    """Rows of the given buckets (None: no time); a bucket is a range of the time, which a scan can skip by."""
    kind = df.schema[time].dataType
    length = F.expr(f"INTERVAL 1 {unit}")
    cond = F.lit(False)
    for at in starts:
        first = F.lit(at).cast(kind)
        cond = cond | (F.col(time).isNull() if at is None else (F.col(time) >= first) & (F.col(time) < first + length))
    return df.where(cond)


def boundary_keys(df: DataFrame, order: Sequence[str], positions: Sequence[int], counts: list[tuple] | None = None) -> list:
    """Key tuple of the row at each 0-based position in ``order`` (None past the end).

    The first column of ``order`` is the time. All positions are narrowed together: one pass
    over the rows for each unit of time, and one that ranks the rows of the seconds found.
    """
    order = list(order)
    time = order[0]
    counts = time_counts(df, time) if counts is None else counts
    total = sum(n for _, n in counts)
    wanted = sorted({p for p in positions if 0 <= p < total})
    if not wanted:
        return [None for _ in positions]
    at = {p: _holding(counts, p) for p in wanted}
    rows = df.select(*order)
    for unit, finer_unit in zip(UNITS, UNITS[1:]):
        known = {bucket for bucket, _ in at.values()}
        finer = time_counts(_within(rows, time, unit, known - {None}), time, finer_unit) if known != {None} else []
        at = {p: (bucket, left) if bucket is None else _holding([c for c in finer if _start(c[0], unit) == bucket], left)
              for p, (bucket, left) in at.items()}
    second = F.date_trunc(UNITS[-1], F.col(time))
    place = F.row_number().over(Window.partitionBy(second).orderBy(*[F.asc_nulls_last(c) for c in order])) - 1
    ranked = _within(rows, time, UNITS[-1], {bucket for bucket, _ in at.values()}).select("*", second.alias("_second"), place.alias("_place"))
    found = {}
    for r in ranked.where(F.col("_place").isin([left for _, left in at.values()])).collect():   # a position's place in each second
        found[r["_second"], r["_place"]] = tuple(r[c] for c in order)
    return [found[at[p]] if p in at else None for p in positions]


def before(df: DataFrame, order: Sequence[str], key) -> DataFrame:
    return df if key is None else df.where(_key_less(order, key))


def at_or_after(df: DataFrame, order: Sequence[str], key) -> DataFrame:
    return df.where(F.lit(False)) if key is None else df.where(~_key_less(order, key))


def between_keys(df: DataFrame, order: Sequence[str], lo, hi) -> DataFrame:
    out = at_or_after(df, order, lo) if lo is not None else df.where(F.lit(False))
    return out if hi is None else out.where(_key_less(order, hi))


def fraction_positions(n: int, fractions: Sequence[float]) -> list[int]:
    """``int(f * n)`` as in slicing ``data[:int(f*n)]``."""
    return [int(f * n) for f in fractions]


def row_fraction_split(df: DataFrame, fraction: float = 0.95,
                       order: Sequence[str] = ("DateTime", "JourneyLinkRef")):
    """(train, test): the first ``int(fraction * n)`` rows in time order, and the rest."""
    counts = time_counts(df, order[0])
    n = sum(c for _, c in counts)
    (key,) = boundary_keys(df, order, fraction_positions(n, [fraction]), counts)
    return before(df, order, key), at_or_after(df, order, key)


def expanding_fold_bounds(n: int, bootstrap: float, step: float, n_folds: int):
    """[(fold, train_end, test_end)] positions: train [0, b_i), test [b_i, b_{i+1})."""
    out = []
    for i in range(n_folds):
        out.append((i, int((bootstrap + i * step) * n), int((bootstrap + (i + 1) * step) * n)))
    return out


def expanding_folds(df: DataFrame, bootstrap: float = 0.80, step: float = 0.05,
                    n_folds: int = 4, order: Sequence[str] = ("DateTime", "JourneyLinkRef")):
    """Yield ``(fold, train, test)`` DataFrames of the expanding-window evaluation."""
    counts = time_counts(df, order[0])
    n = sum(c for _, c in counts)
    bounds = expanding_fold_bounds(n, bootstrap, step, n_folds)
    positions = sorted({p for _, a, b in bounds for p in (a, b)})
    keys = dict(zip(positions, boundary_keys(df, order, positions, counts)))
    for fold, a, b in bounds:
        train = before(df, order, keys[a]) if a < n else df
        test = between_keys(df, order, keys[a], keys[b]) if a < n else df.where(F.lit(False))
        yield fold, train, test


def tag_folds(df: DataFrame, bootstrap: float = 0.80, step: float = 0.05, n_folds: int = 4,
              order: Sequence[str] = ("DateTime", "JourneyLinkRef")) -> DataFrame:
    """Every row with its ``segment``: -1 before the first test window, i for test
    window i, ``n_folds`` after the last. Fold i trains on segments < i and tests on i."""
    counts = time_counts(df, order[0])
    n = sum(c for _, c in counts)
    bounds = expanding_fold_bounds(n, bootstrap, step, n_folds)
    positions = [bounds[0][1]] + [b for _, _, b in bounds]
    keys = boundary_keys(df, order, positions, counts)
    seg = F.lit(n_folds)
    for i in range(len(keys) - 1, -1, -1):
        # a boundary at or past the end (no key) lies after every row
        seg = (F.when(_key_less(order, keys[i]), F.lit(i - 1)).otherwise(seg)
               if keys[i] is not None else F.lit(i - 1))
    return df.withColumn("segment", seg.cast("int"))


def position_folds(n_windows: int, bootstrap: float = 0.75, step: float = 0.05,
                   n_folds: int = 5) -> list[tuple[int, int]]:
    """Expanding folds on window positions: start ``int(n*b)``, width ``int(n*s)``,
    at most ``n_folds``, capped by ``n`` (the oldest variant)."""
    start, width = int(n_windows * bootstrap), int(n_windows * step)
    if width <= 0:
        return []
    return [(i, i + width) for i in range(start, min(start + n_folds * width, n_windows), width)]


def tag_position_folds(rows: DataFrame, position: str, n_windows: int, bootstrap: float = 0.75, step: float = 0.05,
                       n_folds: int = 5) -> tuple[DataFrame, int]:
    """(rows with their ``segment``, folds): ``position_folds`` over windows that know their position.

    Segment -1 trains every fold, segment i is tested by fold i and trains the later ones; rows
    after the last fold are in segment ``folds``. Positions come with the series (bins are laid
    out along a spine), so nothing is numbered here.
    """
    folds = position_folds(n_windows, bootstrap, step, n_folds)
    if not folds:
        return rows.withColumn("segment", F.lit(-1)), 0
    start, width = folds[0][0], folds[0][1] - folds[0][0]
    at = F.col(position)
    segment = F.when(at < start, -1).otherwise(F.least(F.floor((at - start) / width), F.lit(len(folds))))
    return rows.withColumn("segment", segment.cast("int")), len(folds)


def date_split(df: DataFrame, ts: str, train_before: str, test_from: str,
               test_before: str | None = None):
    """(train, test): ``ts < train_before`` and ``test_from <= ts [< test_before]``."""
    t = F.col(ts)
    train = df.where(t < F.lit(train_before).cast("timestamp_ntz"))
    test = df.where(t >= F.lit(test_from).cast("timestamp_ntz"))
    if test_before is not None:
        test = test.where(t < F.lit(test_before).cast("timestamp_ntz"))
    return train, test
