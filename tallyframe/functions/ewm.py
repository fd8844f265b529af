"""Exponentially weighted means of long series, by chunks.

The mean is a linear recursion, so a chunk of bars can be computed as if it began the series, and what came before it is
one number, scaled by a power of the decay. Chunks are computed side by side; only their last values are chained.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars in a chunk.
CHUNK = 8192


def span(n: float) -> float:
    """The weight of the newest value of a mean of that span."""
    return 2.0 / (n + 1)


def _local(x: pd.Series, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a chunk as if it began the series, and the part of its first mean that is left in each of the others. Both
    are NaN before the first value. A value after g missing ones meets the mean before with a weight of decay^(g+1) to its
    own ``alpha``, both over their sum."""
    mean = x.ewm(alpha=alpha, adjust=False).mean().to_numpy()
    known = np.flatnonzero(x.notna().to_numpy())
    left = np.full(len(x), np.nan)
    if len(known):
        old = (1.0 - alpha) ** np.diff(known)
        left[known] = np.concatenate([[1.0], np.cumprod(old / (old + alpha))])
        left = pd.Series(left).ffill().to_numpy()
    return mean, left


def with_ewm(bars: DataFrame, means: Mapping[str, tuple[str, float]], keys: tuple[str, ...] = ("symbol",), order: str = "bar_i", chunk: int = CHUNK) -> DataFrame:
    """``bars`` with a column for each of ``means``: name -> (column, weight of the newest value).

    ``order`` numbers a series' bars from 0 without gaps. The first mean is the first value; a missing value leaves the
    mean where it was, weights counting its place. An empty table stays empty.

    A chunk is an affine map of the mean that enters it, so these means are chained over one row for each chunk of the
    series that have several; nothing runs while the query is built.
    """
    names = list(means)
    alphas = np.array([means[n][1] for n in names])
    work = bars.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    kinds = dict(bars.dtypes)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in work.schema.fields)}, {', '.join(f'`{n}` double' for n in names)}, _left array<double>"
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        both = [_local(frame[means[n][0]].astype(float), means[n][1]) for n in names]
        for n, (mean, _) in zip(names, both, strict=True):
            frame[n] = mean
        frame["_left"] = list(np.stack([left for _, left in both], axis=1))
        return frame

    def summed_up(frame: pd.DataFrame) -> pd.DataFrame:
        """Of each mean: its last local value, what is left of the first one, the first value, the bars before it and those
        after the last value. A chunk without values has as many bars before the first as it has at all."""
        frame = frame.sort_values(order, kind="stable")
        rows = []
        for n in names:
            x = frame[means[n][0]].astype(float)
            mean, left = _local(x, means[n][1])
            known = np.flatnonzero(x.notna().to_numpy())
            ends = (x.iloc[known[0]], known[0], len(x) - 1 - known[-1]) if len(known) else (np.nan, len(x), 0)
            rows.append([mean[-1], left[-1], *map(float, ends)])
        out = frame[[*keys, "_chunk"]].head(1).copy()
        out["_ends"] = [np.array(rows, dtype=float).ravel()]
        return out

    def chained(ends: pd.DataFrame) -> pd.DataFrame:
        """The mean before each chunk, and what it moves the chunk's first mean by."""
        ends = ends.sort_values("_chunk")
        mean, gap, before, shift = np.full(len(names), np.nan), np.zeros(len(names)), [], []
        for flat in ends["_ends"]:
            last, left, first, lead, after = np.asarray(flat, float).reshape(len(names), 5).T
            old = (1.0 - alphas) ** (gap + lead + 1)
            moved = np.where(np.isnan(mean), 0.0, old / (old + alphas) * (mean - first))
            before.append(mean)
            shift.append(moved)
            empty = np.isnan(last)
            mean, gap = np.where(empty, mean, last + left * moved), np.where(empty, gap + lead, after)
        out = ends[[*keys, "_chunk"]].copy()
        out["_before"], out["_shift"] = before, shift
        return out

    done = work.groupBy(*keys, "_chunk").applyInPandas(local, schema)
    several = work.withColumn("_most", F.max("_chunk").over(Window.partitionBy(*keys))).where("_most > 0").drop("_most")
    ends = several.groupBy(*keys, "_chunk").applyInPandas(summed_up, f"{key_schema}, _chunk long, _ends array<double>")
    entered = ends.groupBy(*keys).applyInPandas(chained, f"{key_schema}, _chunk long, _before array<double>, _shift array<double>")
    joined = done.join(entered, [*keys, "_chunk"], "left")
    known = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    for k, n in enumerate(names):
        moved = known(F.col(n)) + F.coalesce(known(F.col("_left")[k] * F.col("_shift")[k]), F.lit(0.0))
        joined = joined.withColumn(n, F.coalesce(moved, known(F.col("_before")[k])))
    return joined.drop("_chunk", "_left", "_before", "_shift")
