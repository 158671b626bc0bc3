"""Row-fraction splits over many files and partitions, with ties and NULL times."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkflow.operators.splits import boundary_keys, expanding_folds, row_fraction_split, tag_folds

ORDER = ("DateTime", "JourneyLinkRef")


@pytest.fixture(params=[8, 40])
def rows(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    base = dt.datetime(2024, 1, 1)
    # times tie by threes, ties of both columns by twos, and 40 rows have no time
    data = [(None if i % 50 == 7 else base + dt.timedelta(seconds=(i * 7919 % 2000) // 3 * 41), f"l{i * 31 % 17}" if i % 90 else None, i)
            for i in range(2000)]
    yield data, spark.createDataFrame(data, "DateTime timestamp_ntz, JourneyLinkRef string, i int").repartition(request.param)
    for k, v in old.items():
        spark.conf.set(k, v)


def _sorted(data):
    return sorted(((d, j) for d, j, _ in data), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def test_boundaries_are_the_rows_at_the_positions(rows):
    data, df = rows
    positions = [0, 1, 500, 1000, 1599, 1900, 1980, 1999, 2000]
    assert boundary_keys(df, ORDER, positions) == [*[_sorted(data)[p] for p in positions[:-1]], None]


def test_parts_are_whole_and_disjoint(rows):
    data, df = rows
    train, test = row_fraction_split(df, 0.95, ORDER)
    key = _sorted(data)[1900]
    below = sum(k != key and _sorted([(*k, 0), (*key, 0)])[0] == k for k in _sorted(data))
    assert train.count() == below and test.count() == 2000 - below
    assert train.select("i").intersect(test.select("i")).count() == 0


def test_folds_cover_each_row_once(rows):
    data, df = rows
    tagged = {r["segment"]: r["count"] for r in tag_folds(df, order=ORDER).groupBy("segment").count().collect()}
    assert sum(tagged.values()) == 2000
    for fold, train, test in expanding_folds(df, order=ORDER):
        assert train.count() == sum(n for s, n in tagged.items() if s < fold) and test.count() == tagged[fold]
    assert tag_folds(df, order=ORDER).where(F.col("DateTime").isNull()).agg(F.min("segment")).first()[0] >= 3
