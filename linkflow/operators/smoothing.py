"""Smoothers: centred rolling mean and the recursive exponentially weighted mean.

``rolling_mean``: average of a centred window of ``window`` rows per key; rows
whose window is not full of values are missing (edges), as a full-window rolling
mean is.

``ewm``: ``y_0 = x_0``, ``y_t = (1 - a) y_{t-1} + a x_t`` (``a = 2 / (span + 1)``) in
(ts, tie) order per key. The recursion is split into time chunks so no task holds a
key's whole history:

1. per (key, chunk), over sorted batches: the recursion started from 0 (``local``) and
   the position inside the chunk;
2. per key, over its small chunk table: the state at each chunk end,
   ``Y_c = (1-a)^{n_c} Y_{c-1} + local_last_c`` with ``Y_{-1} = x_0``;
3. per row: ``y = (1-a)^{k} Y_{c-1} + local`` (k = position in chunk, from 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_time


def rolling_mean(df: DataFrame, value: str, key: str, order: str, window: int = 7,
                 out: str | None = None) -> DataFrame:
    half = window // 2
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, window - 1 - half)
    full = F.count(F.col(value)).over(w) == window
    return df.withColumn(out or f"{value}_smooth", F.when(full, F.avg(F.col(value)).over(w)))


def _local_recursion(alpha: float):
    def fn(frames):
        last, acc, k = None, 0.0, 0    # of the chunk that the previous batch ended in
        for pdf in frames:
            if pdf.empty:
                continue
            group = pdf.groupby(["_key", "_chunk"], sort=False).ngroup().to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(pdf)]
            x = pdf["_x"].to_numpy(dtype=float)
            local, pos = np.empty(len(pdf)), np.empty(len(pdf), dtype=np.int64)
            for at, end in zip(starts, starts[1:]):
                here = (pdf["_key"].iat[at], pdf["_chunk"].iat[at])
                if here != last:
                    last, acc, k = here, 0.0, 0
                run = pd.Series(np.concatenate([[acc], x[at:end]])).ewm(alpha=alpha, adjust=False).mean()
                local[at:end] = run.to_numpy()[1:]
                pos[at:end] = np.arange(k + 1, k + 1 + end - at)
                acc, k = local[end - 1], k + end - at
            yield pd.DataFrame({"_key": pdf["_key"], "_chunk": pdf["_chunk"], "_tie": pdf["_tie"],
                                "_k": pos, "_local": local})
    return fn


def _chunk_states(alpha: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", kind="mergesort")
        state = float(pdf["_x0"].iloc[0])
        prev = np.empty(len(pdf))
        for i, (n, last) in enumerate(zip(pdf["_n"].to_numpy(), pdf["_last"].to_numpy())):
            prev[i] = state
            state = (1.0 - alpha) ** int(n) * state + float(last)
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "_chunk": pdf["_chunk"].to_numpy(),
                             "_prev": prev})
    return fn


def ewm(df: DataFrame, value: str, key: str = "LinkRef", ts: str = "DateTime",
        tie: str = "JourneyLinkRef", span: float = 12.0, chunk="1h",
        out: str = "ewm") -> DataFrame:
    """Recursive (``adjust=False``) exponentially weighted mean per key.

    Rows without key, time or value have no place in the recursion and are left out. ``tie``
    must be unique. Sorted chunks stream through a task batch by batch, so memory does not
    depend on how many rows a chunk has; the table of states has one row per key and chunk.
    """
    alpha = 2.0 / (span + 1.0)
    src = df.dropna(subset=[key, ts, value])
    base = src.select(F.col(key).cast("string").alias("_key"), floor_time(ts, chunk).alias("_chunk"),
                      F.col(ts).alias("_ts"), F.col(tie).cast("long").alias("_tie"),
                      F.col(value).cast("double").alias("_x"))
    local = base.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_ts", "_tie").mapInPandas(
        _local_recursion(alpha),
        "_key string, _chunk timestamp_ntz, _tie long, _k long, _local double")
    first_x = base.groupBy("_key").agg(F.min_by("_x", F.struct("_ts", "_tie")).alias("_x0"))
    per_chunk = (local.groupBy("_key", "_chunk")
                 .agg(F.count(F.lit(1)).alias("_n"), F.max_by("_local", "_k").alias("_last"))
                 .join(first_x, "_key"))
    states = per_chunk.groupBy("_key").applyInPandas(
        _chunk_states(alpha), "_key string, _chunk timestamp_ntz, _prev double")
    y = (local.join(states, ["_key", "_chunk"])
         .select("_key", "_tie", (F.pow(F.lit(1.0 - alpha), F.col("_k")) * F.col("_prev")
                                  + F.col("_local")).alias(out)))
    return src.join(y.withColumnRenamed("_key", "_k2").withColumnRenamed("_tie", "_t2"),
                    (F.col(key).cast("string") == F.col("_k2")) & (F.col(tie).cast("long") == F.col("_t2"))) \
              .drop("_k2", "_t2")
