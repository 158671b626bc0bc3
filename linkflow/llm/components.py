"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node of its component.

    Contraction: each round every node is merged into the smallest of its neighbours and
    itself, both ends of the links are replaced by what they were merged into, and loops and
    repeated links are dropped, so the table shrinks by a factor each round (nodes must be in
    no particular order along the links, as digests are). The rounds' merges are then followed
    back from the last. Tables are written to the shared checkpoint folder; one count a round
    comes to the driver.
    """
    left = materialize(_distinct(links), "links")
    merges = []
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "merges")
        merges.append(into)
        moved = left
        for end in ("a", "b"):
            to = into.select(F.col("node").alias(end), F.col("root").alias("to"))
            moved = moved.join(to, end).drop(end).withColumnRenamed("to", end)
        left = materialize(_distinct(moved), "links")
    if not merges:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    known = merges.pop()
    while merges:
        later = known.select(F.col("node").alias("root"), F.col("root").alias("last"))
        known = merges.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return _to_least(known)


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _to_least(labels: DataFrame) -> DataFrame:
    """A component's nodes all end at one node; the smallest one takes its place."""
    labels = materialize(labels, "labels")
    least = labels.groupBy("root").agg(F.least("root", F.min("node")).alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
