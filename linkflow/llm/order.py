"""Positions of rows in one order over a whole table, without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkflow.session import materialize

PLACE_BITS = 33                # of monotonically_increasing_id: the row number inside a partition


def laid_out(df: DataFrame, order: list[str], place: str, name: str = "laid-out") -> DataFrame:
    """``df`` range-partitioned and sorted by ``order`` (nulls first), written, with an ascending ``place``.

    Rows of one value of the leading columns are dealt over tasks by the later ones, so name
    enough of them. The table is written because a place holds only for one partitioning.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(place, F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, order: list[str], at: str, part: str, name: str = "numbered") -> DataFrame:
    """``laid_out`` rows with their position ``at`` (from 0, no gaps) and their partition ``part``."""
    laid = laid_out(df, order, "__place", name).withColumn(part, F.shiftright("__place", PLACE_BITS))
    rows = laid.groupBy(part).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)      # one row a partition
    before = rows.select(part, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (laid.join(F.broadcast(before), part)                                   # one row a partition
            .withColumn(at, F.col("__before") + inside).drop("__place", "__before"))
