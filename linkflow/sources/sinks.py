"""Sinks: wide CSV of a series, GeoJSON features, geometry tables.

Long form ``(index, column key, value)`` is the native form; the wide form (one
column per link) is produced only at the edge, always with an explicit column list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BLOCK_COLUMNS = 256            # links side by side in one block of a wide output


def link_order(links: DataFrame) -> DataFrame:
    """``(LinkRef, link_index)``: links in display order, by their smallest ``LineDirectionLinkOrder``.

    ``links`` may be any table with both columns; one row a link is ranked.
    """
    first = links.groupBy("LinkRef").agg(F.min("LineDirectionLinkOrder").alias("order"))
    ranked = F.row_number().over(Window.orderBy("order", "LinkRef")) - 1
    return first.select("LinkRef", ranked.alias("link_index"))


def to_wide(long: DataFrame, index: str, columns: str, values: str, values_list: Sequence) -> DataFrame:
    """One row per ``index``, one column per entry of ``values_list`` (links in display order)."""
    return long.groupBy(index).pivot(columns, list(values_list)).agg(F.first(values))


def write_wide_csv(long: DataFrame, path: str, values_list: Sequence, index: str = "bin_ts", columns: str = "LinkRef",
                   values: str = "seconds") -> None:
    """Wide CSV with a header, overwriting ``path``."""
    (to_wide(long, index, columns, values, values_list).orderBy(index)
     .write.mode("overwrite").option("header", True).csv(path))


def write_forecast(forecast: DataFrame, path: str, by: Sequence[str] = ("model", "fold")) -> None:
    """Long Parquet ``(model, fold, bin_ts, LinkRef, seconds)``, replacing the partitions written and no others.

    Rows are dealt by link and sorted by time, so a rerun writes files of equal content.
    """
    parts = int(forecast.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (forecast.repartition(parts, "LinkRef").sortWithinPartitions(*by, "bin_ts", "LinkRef").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_wide_blocks(long: DataFrame, path: str, order: DataFrame, index: str = "bin_ts", values: str = "seconds",
                      width: int = BLOCK_COLUMNS) -> None:
    """Wide CSV in blocks of ``width`` links: ``path/rows/block=k`` and the columns' links in ``path/links``.

    Links stand in display order (``link_order``); a block has the columns ``index, c0 .. c{width-1}``,
    so one pass writes any number of links and no row is wider than a block.
    """
    placed = order.select("LinkRef", F.floor(F.col("link_index") / width).alias("block"),
                          F.concat(F.lit("c"), F.col("link_index") % width).alias("column"))
    placed.write.mode("overwrite").parquet(f"{path}/links")
    placed = order.sparkSession.read.parquet(f"{path}/links")
    names = [f"c{i}" for i in range(width)]
    wide = long.join(placed, "LinkRef").groupBy("block", index).pivot("column", names).agg(F.first(values))
    (wide.repartition("block").sortWithinPartitions("block", index).write.mode("overwrite")
     .partitionBy("block").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{path}/rows"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features (column ``feature`` holds the JSON text)."""
    features.select("feature").write.mode("overwrite").text(path)


def write_table_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
