"""Data assertions that are checked by the job that writes a table.

An expectation is an aggregate and the value it must have. ``written`` writes a table with the
aggregates observed on the way (``DataFrame.observe``), so nothing is scanned a second time, and
fails if one differs. Distinct links are counted by their marker row -- every link has one row
of slot 0, of the first position, or at all -- which needs no set of links anywhere.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .session import materialize


class Expectation(NamedTuple):
    name: str
    found: Column        # an aggregate
    wanted: int


class DataError(ValueError):
    """A written table is not what was expected of it."""


def expect_links(links: int, marker: Column | None = None) -> list[Expectation]:
    """``links`` rows for which ``marker`` holds (all rows if not given: tables of one row a link)."""
    return [Expectation("links", F.count_if(F.lit(True) if marker is None else marker), links)]


def expect_profile(links: int, slots: int = 672) -> list[Expectation]:
    """A filled profile: every slot of every link, no missing mean, no band upside down."""
    return [*expect_links(links, F.col("slot") == 0), Expectation("rows", F.count(F.lit(1)), links * slots),
            Expectation("missing_means", F.count_if(F.col("mean").isNull()), 0),
            Expectation("bands_upside_down", F.count_if(F.col("low") > F.col("upr")), 0)]


def written(df: DataFrame, name: str, expectations: list[Expectation]) -> DataFrame:
    """``materialize`` that raises ``DataError`` if an expectation does not hold for the written rows."""
    if not expectations:
        return materialize(df, name)
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    table = materialize(df.observe(seen, *[e.found.alias(e.name) for e in expectations]), name)
    found = seen.get
    wrong = [f"{e.name}: {found.get(e.name)} instead of {e.wanted}" for e in expectations if found.get(e.name) != e.wanted]
    if wrong:
        raise DataError(f"{name}: {'; '.join(wrong)}")
    return table
