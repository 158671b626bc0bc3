"""Gap filling along an ordered position, in time linear in the number of rows.

* pad   -- last known value up to the row;
* bfill -- next known value from the row on;
* interpolate -- linear by position between the surrounding known values; a trailing gap
  takes the last value, a leading gap stays missing (then usually bfilled).

``pad``, ``bfill`` and ``interpolate`` are window columns for partitions of a bounded length,
such as the slots of one link's week. The next value is a running ``last`` over the reversed
order: a frame that ends at the row, so every row is added to it once.

``carried`` is the form for series of any length. Positions are cut into chunks of ``CHUNK``;
windows run inside a (key, chunk) only. The first and last known value of every chunk make a
small table, along which they are carried over chunks without any; no task holds a key's
history. Known rows and the positions to fill are laid together by a union, not a join, so the
dense table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096                   # positions of one key that one window partition holds


def _running(partition: Sequence[str], *order) -> "Window":
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _upto(partition: Sequence[str], order: str):
    return _running(partition, F.asc(order))


def _onwards(partition: Sequence[str], order: str):
    return _running(partition, F.desc(order))


def pad(value: str, partition: Sequence[str], order: str) -> Column:
    return F.last(F.col(value), ignorenulls=True).over(_upto(partition, order))


def bfill(value: str, partition: Sequence[str], order: str) -> Column:
    return F.last(F.col(value), ignorenulls=True).over(_onwards(partition, order))


def _between(before_at: Column, before: Column, after_at: Column, after: Column, at: Column) -> Column:
    """The line from (before_at, before) to (after_at, after) at ``at``; NULL without either end."""
    return before + F.try_divide((after - before) * (at - before_at).cast("double"), (after_at - before_at).cast("double"))


def interpolate(value: str, partition: Sequence[str], order: str, then_bfill: bool = True) -> Column:
    """Linear interpolation by the (numeric) order column, trailing gap padded, optionally then bfill."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("is")))
    before = F.last(known, ignorenulls=True).over(_upto(partition, order))
    after = F.last(known, ignorenulls=True).over(_onwards(partition, order))
    return _filled_line(before, after, F.col(order), then_bfill)


def _filled_line(before: Column, after: Column, at: Column, then_bfill: bool) -> Column:
    own = F.when(before["at"] == at, before["is"])
    line = _between(before["at"], before["is"], after["at"], after["is"], at)
    parts = [own, line, before["is"]]       # a trailing gap (no next value) takes the last value
    return F.coalesce(*parts, after["is"]) if then_bfill else F.coalesce(*parts)


class Carried:
    """Columns of a ``carried`` table: fills of one value, read at each position."""

    def __init__(self, value: str, position: str):
        self.before, self.after, self.at = F.col(f"_before_{value}"), F.col(f"_after_{value}"), F.col(position)

    def own(self) -> Column:
        return F.when(self.before["at"] == self.at, self.before["is"])

    def pad(self) -> Column:
        return self.before["is"]

    def bfill(self) -> Column:
        return self.after["is"]

    def interpolate(self, then_bfill: bool = True) -> Column:
        return _filled_line(self.before, self.after, self.at, then_bfill)


def carried(spine: DataFrame, known: DataFrame, keys: Sequence[str], position: str, values: Sequence[str],
            chunk: int = CHUNK) -> DataFrame:
    """``spine`` (keys, position, ...) with the known values around every position; read by ``Carried``.

    ``known``: (keys, position, values), one row per key and position, which need not be in
    the spine. NULL values are not known. Keys are not null.
    """
    keys = list(keys)
    part = [*keys, "_chunk"]
    in_chunk = F.floor(F.col(position) / chunk).alias("_chunk")
    others = [c for c in spine.columns if c not in (*keys, position)]

    def point(v):
        return F.when(F.col(v).isNotNull(), F.struct(F.col(position).alias("at"), F.col(v).alias("is")))

    ends = known.groupBy(*keys, in_chunk).agg(*[F.max(point(v)).alias(f"_last_{v}") for v in values],
                                              *[F.min(point(v)).alias(f"_first_{v}") for v in values])
    chunks = spine.select(*keys, in_chunk).unionByName(known.select(*keys, in_chunk)).distinct()
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.join(ends, part, "left").select(
        *part, *[F.last(f"_last_{v}", ignorenulls=True).over(earlier).alias(f"_in_{v}") for v in values],
        *[F.last(f"_first_{v}", ignorenulls=True).over(later).alias(f"_out_{v}") for v in values])

    fields = dict((f.name, f.dataType) for f in known.schema)
    kept = dict((f.name, f.dataType) for f in spine.schema)
    wanted = spine.select(*keys, position, in_chunk, F.lit(1).alias("_wanted"), *others,
                          *[F.lit(None).cast(fields[v]).alias(f"_own_{v}") for v in values])
    points = known.select(*keys, F.col(position).cast(kept[position]).alias(position), in_chunk, F.lit(0).alias("_wanted"),
                          *[F.lit(None).cast(kept[c]).alias(c) for c in others], *[F.col(v).alias(f"_own_{v}") for v in values])
    rows = wanted.unionByName(points).join(carry, part)
    forward, backward = (_running(part, way(position), F.asc("_wanted")) for way in (F.asc, F.desc))

    def around(v, window, beyond):
        own = F.when(F.col(f"_own_{v}").isNotNull(), F.struct(F.col(position).alias("at"), F.col(f"_own_{v}").alias("is")))
        return F.coalesce(F.last(own, ignorenulls=True).over(window), F.col(beyond))

    found = rows.select(*keys, position, *others, "_wanted",
                        *[around(v, forward, f"_in_{v}").alias(f"_before_{v}") for v in values],
                        *[around(v, backward, f"_out_{v}").alias(f"_after_{v}") for v in values])
    return found.where(F.col("_wanted") == 1).drop("_wanted")
