"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A source's mean repetition rate is its target share of the mixture's code points over its
own share of the corpus: ``rate = weight * total / size``. A document's number of copies is
a Poisson number with that mean, inverted from a uniform number that is a hash of the seed,
the doc_id and the text, so every run, retry and partitioning gives the same copies. Rates
above ``SPLIT`` are drawn as a sum of independent parts, so no probability underflows. Each
document is exploded by its count, and the copies are shuffled globally: dealt over
partitions and sorted within them by a hash of document, copy and seed.

Without given weights the target is the tempered one: weights in proportion to
``size ** temperature``. Weights need not add to one; sources without a weight (and those
of weight 0) give no rows. A null source is a source of its own. A null text counts as
empty; if all texts are empty, rows are counted instead of code points. Repeated rows have
equal counts. All input columns are kept as they are; the copy number and mixing key are added
under the names given, with ``_`` behind a name that the input has already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.session import materialize

TEMPERATURE = 0.5
SEED = 20240601
SPLIT = 32.0                   # largest mean inverted at once


def hash52(*parts: Column) -> Column:
    """A hash of the parts as an integer below 2**52 (the first 13 hex digits of an md5)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, size, rate): code points and mean repetition rate of every source."""
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count(F.lit(1)).alias("rows"))
    all_ = sizes.agg(F.sum("chars").alias("all_chars"))
    sizes = sizes.crossJoin(F.broadcast(all_)).select(     # one row: the total
        "source", F.when(F.col("all_chars") > 0, F.col("chars")).otherwise(F.col("rows")).cast("double").alias("size"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").cast("double").alias("weight"))
        wanted = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select(
            "source", "size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    sums = wanted.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    return wanted.crossJoin(F.broadcast(sums)).select(     # one row again
        "source", F.col("size").cast("long").alias("size"),
        F.when((F.col("size") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * F.col("total") / F.col("size"))
        .otherwise(F.lit(0.0)).alias("raw")).withColumn("rate", F.round("raw", 9)).drop("raw")


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... for a Poisson number, far into its tail."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    zero = F.exp(-mean)
    begin = F.struct(F.array(zero).alias("table"), zero.alias("p"), zero.alias("total"))

    def add(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(F.concat(a["table"], F.array(a["total"] + p)).alias("table"), p.alias("p"), (a["total"] + p).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, add, lambda a: a["table"])


def poisson_count(table: Column, parts: Column, key: Column, seed: int) -> Column:
    """Sum of ``parts`` Poisson numbers, each inverted in ``table`` from its own hash of ``key``."""
    def one(i: Column) -> Column:
        u = (hash52(F.lit(str(seed)), i.cast("string"), key) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.size(F.filter(table, lambda c: c < u))

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda a, i: a + one(i))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, seed: int = SEED,
                copy: str = "mix_copy", order: str = "mix_key") -> DataFrame:
    """The mixture: every input column, the copy number (from 1) and the shuffling key."""
    rates = materialize(
        source_rates(docs, weights, temperature).where("rate > 0")
        .withColumn("parts", F.ceil(F.col("rate") / SPLIT).cast("int"))
        .select(F.col("source").alias("of"), "parts", poisson_table(F.col("rate") / F.col("parts")).alias("table")), "rates")
    while copy in docs.columns:
        copy += "_"
    while order in (*docs.columns, copy):
        order += "_"
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select("source", key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    drawn = rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("n", poisson_count(F.col("table"), F.col("parts"), F.col("key"), seed))
    copies = drawn.where("n > 0").select("kept", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    dealt = copies.withColumn("place", hash52(F.lit(f"order {seed}"), F.col("copy").cast("string"), F.col("key")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(parts, F.col("place")).sortWithinPartitions("place", "key")
            .select("kept.*", F.col("copy").alias(copy), F.col("place").alias(order)))
