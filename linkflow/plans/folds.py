"""Expanding folds fitted together, from additive sums of segments.

The folds cut the observations into segments: segment -1 trains every fold, segment i is the
test part of fold i and trains the folds after it. One scan of the observations (``fold_state``)
sums two things per segment, by grouping sets: how often every (link, slot, value) occurs,
which is the profile's state, and the ``cell_sums`` of every (link, bin, slot). Both add up, so
the training part of each fold is a sum over its segments; the profiles of all folds are fitted
in one job, and so are the series, windows and regressions, with the fold as one more key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import to_fixed
from ..operators import profile as pr
from ..operators import series as se
from ..operators import splits as sp
from ..operators import windows as wn
from ..session import materialize

FOLD = ["fold"]


def training(rows: DataFrame, folds: int) -> DataFrame:
    """Rows of every segment under each ``fold`` that it trains."""
    later = F.sequence(F.col("segment") + 1, F.lit(folds - 1))
    return rows.where(F.col("segment") < folds - 1).withColumn("fold", F.explode(later)).drop("segment")


class FoldState:
    """Sums per segment: ``counts`` (segment, LinkRef, slot, value, _n), ``cells`` (segment, LinkRef, bin_ts, slot, ...)."""

    def __init__(self, counts: DataFrame, cells: DataFrame, folds: int, freq):
        self.counts, self.cells, self.folds, self.freq = counts, cells, folds, freq

    def train_cells(self) -> DataFrame:
        return training(self.cells, self.folds).groupBy(*FOLD, "LinkRef", "bin_ts", "slot").agg(
            *[F.sum(c).alias(c) for c in ("total", "seen", "rows")])

    def test_cells(self) -> DataFrame:
        return self.cells.where(F.col("segment") >= 0).withColumnRenamed("segment", "fold")

    def fit(self) -> pr.Profile:
        """The profiles of all folds' training parts."""
        merged = training(self.counts, self.folds).groupBy(*FOLD, "LinkRef", "slot", pr.VALUE).agg(F.sum("_n").alias("_n"))
        return pr.fit_counted(merged, self.freq, by=FOLD)

    def series(self, profile: pr.Profile, cells: DataFrame) -> DataFrame:
        """``(fold, LinkRef, bin_ts, z, ...)`` of the train or test cells, scaled by their fold's profile."""
        return se.transform_cells(cells, profile, self.freq, by=FOLD)


def fold_state(obs: DataFrame, bootstrap: float, step: float, folds: int, freq="15min",
               order: Sequence[str] = ("DateTime", "JourneyLinkRef")) -> FoldState:
    """One scan of ``obs`` (after the passes over its times that find the folds' boundaries)."""
    tagged = sp.tag_folds(obs, bootstrap, step, folds, order).where(F.col("segment") < folds)
    keyed = pr.with_time_keys(tagged, freq).select("segment", "LinkRef", "slot", F.col("DateTimeRef").alias("bin_ts"), pr.VALUE)
    keyed = keyed.withColumn("observed", F.col(pr.VALUE))        # the grouped copy is NULL in the other set
    sets = [[F.col(c) for c in ("segment", "LinkRef", "slot", pr.VALUE)], [F.col(c) for c in ("segment", "LinkRef", "slot", "bin_ts")]]
    summed = keyed.groupingSets(sets, "segment", "LinkRef", "slot", "bin_ts", pr.VALUE).agg(
        F.grouping(pr.VALUE).alias("_cell"), F.count(F.lit(1)).alias("rows"), F.count("observed").alias("seen"),
        F.sum(to_fixed("observed")).alias("total"))
    summed = materialize(summed, "fold-state")
    counts = summed.where((F.col("_cell") == 0) & F.col(pr.VALUE).isNotNull()).select(
        "segment", "LinkRef", "slot", pr.VALUE, F.col("rows").alias("_n"))
    cells = summed.where(F.col("_cell") == 1).select("segment", "LinkRef", "bin_ts", "slot", "total", "seen", "rows")
    return FoldState(counts, cells, folds, freq)


def fold_windows(state: FoldState, lags: int, preds: int) -> tuple[DataFrame, DataFrame]:
    """(train windows, test windows) of all folds, each ``(fold, LinkRef, bin_ts, t, X, Y, ...)``."""
    profile = state.fit()
    return tuple(wn.roll(state.series(profile, cells), lags, preds, key=[*FOLD, "LinkRef"])
                 for cells in (state.train_cells(), state.test_cells()))
