"""Join of a large side with a side that is usually small.

No hint is given: Spark compares the known bytes of the small side (a scanned dimension or a
table written by ``materialize``) with ``spark.sql.autoBroadcastJoinThreshold`` and broadcasts
it below that; above it both sides are shuffled on the keys, and AQE re-plans from measured
sizes and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``big`` with a dimension, profile or scale table; ``how`` as seen from ``big``."""
    return big.join(small, on=on, how=how)
