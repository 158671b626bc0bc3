"""Linear recurrences along a series: ``y_t = input_t + factor * y_{t-1}``, y before the start 0.

The map from the state before a chunk of positions to the state after it is affine; the maps of
the chunks are composed on a small table, so no task holds a key's history:

1. per (key, chunk), over sorted batches: the recurrence started from 0 (``local``);
2. per key, over its chunk table: the state before each chunk, ``factor ** n * before + last``;
3. per row, k-th of its chunk: ``y = local + factor ** k * before``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def _local(keys: list[str], position: str):
    def run(frames):
        last, acc, k = None, 0.0, 0
        for pdf in frames:
            if pdf.empty:
                continue
            part = list(zip(*(pdf[c] for c in [*keys, "_chunk"])))
            local, count = np.empty(len(pdf)), np.empty(len(pdf), np.int64)
            for i, (here, x, f) in enumerate(zip(part, pdf["_x"].to_numpy(float), pdf["_f"].to_numpy(float))):
                if here != last:
                    last, acc, k = here, 0.0, 0
                acc, k = x + f * acc, k + 1
                local[i], count[i] = acc, k
            yield pdf[[*keys, "_chunk", position]].assign(_f=pdf["_f"], _local=local, _k=count)

    return run


def _before(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", kind="mergesort")
        state, out = 0.0, []
        for f, n, last in zip(pdf["_f"], pdf["_n"], pdf["_last"]):
            out.append(state)
            state = float(np.float64(f) ** int(n)) * state + float(last) if state else float(last)
        return pdf[[*keys, "_chunk"]].assign(_before=out)

    return run


def linear_recurrence(df: DataFrame, keys: Sequence[str], position: str, value: str, factor: str, out: str = "y",
                      chunk: int = CHUNK) -> DataFrame:
    """``(keys, position, out)`` of the rows of ``df``, in order of the integer ``position``.

    ``factor`` is one number per key; beyond 1 in size y grows without end, to infinity. Rows without value, factor, key or position are left out;
    a position occurs once per key.
    """
    keys = list(keys)
    part = [*keys, "_chunk"]
    rows = df.dropna(subset=[*keys, position, value, factor]).select(
        *keys, F.floor(F.col(position) / chunk).alias("_chunk"), position,
        F.col(value).cast("double").alias("_x"), F.col(factor).cast("double").alias("_f"))
    typed = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema}
    local = rows.repartition(*part).sortWithinPartitions(*part, position).mapInPandas(
        _local(keys, position), ", ".join([*(typed[c] for c in [*part, position, "_f"]), "_local double", "_k long"]))
    ends = local.groupBy(*part).agg(F.first("_f").alias("_f"), F.count(F.lit(1)).alias("_n"), F.max_by("_local", "_k").alias("_last"))
    before = ends.groupBy(*keys).applyInPandas(_before(keys), ", ".join([*(typed[c] for c in part), "_before double"]))
    return local.join(before, part).select(*keys, position, (F.col("_local") + F.pow("_f", "_k") * F.col("_before")).alias(out))
