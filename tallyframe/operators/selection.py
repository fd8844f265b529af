"""Sequential selection from ordered candidates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feasible(bars: DataFrame, warmup: int, horizon: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Whether a bar has enough bars before it, and after it for an outcome."""
    last = F.max("bar_i").over(Window.partitionBy(*keys))
    return (F.col("bar_i") >= warmup) & (F.col("bar_i") + horizon + 1 <= last)


def _by_cluster(rows: DataFrame, gap: int, keys: tuple[str, ...]) -> DataFrame:
    """Numbers the clusters of candidates that lie less than ``gap`` apart in a chain: choices in different ones don't
    touch, so each cluster is chosen from by itself, and a long series is many small tasks."""
    w = Window.partitionBy(*keys).orderBy("bar_i")
    start = F.coalesce(F.col("bar_i") - F.lag("bar_i").over(w) >= gap, F.lit(True))
    return rows.withColumn("_cluster", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _chosen(rows: DataFrame, gap: int, keys: tuple[str, ...], choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        return frame.iloc[sorted(choose(frame))].drop(columns="_cluster")

    return _by_cluster(rows, gap, keys).groupBy(*keys, "_cluster").applyInPandas(run, rows.schema)


def greedy_gap(rows: DataFrame, score: str, gap: int = 18, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Best score first, every candidate that is at least ``gap`` bars from all kept ones; of equals the earlier bar."""

    def choose(frame: pd.DataFrame) -> list[int]:
        kept: list[int] = []
        at = frame["bar_i"].to_numpy()
        for k in frame.assign(_s=-frame[score].fillna(float("-inf"))).sort_values(["_s", "bar_i"], kind="stable").index:
            if all(abs(at[k] - at[j]) >= gap for j in kept):
                kept.append(k)
        return kept

    return _chosen(rows, gap, keys, choose)


def min_gap(rows: DataFrame, gap: int = 18, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """From left to right, every candidate at least ``gap`` bars after the last kept one."""

    def choose(frame: pd.DataFrame) -> list[int]:
        kept, last = [], None
        for k in frame.sort_values("bar_i").index:
            if last is None or frame.at[k, "bar_i"] - last >= gap:
                kept.append(k)
                last = frame.at[k, "bar_i"]
        return kept

    return _chosen(rows, gap, keys, choose)


def segments(rows: DataFrame, condition: Column, merge_gap: int = 3, least: int = 5, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, start_i, end_i, n_bars): runs of bars for which the condition holds, joined over up to ``merge_gap`` bars."""
    w = Window.partitionBy(*keys).orderBy("bar_i")
    hits = rows.where(F.coalesce(condition, F.lit(False))).select(*keys, "bar_i")
    start = F.coalesce(F.col("bar_i") - F.lag("bar_i").over(w) > merge_gap + 1, F.lit(True))
    numbered = hits.withColumn("_s", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "_s").agg(F.min("bar_i").alias("start_i"), F.max("bar_i").alias("end_i"))
    return found.withColumn("n_bars", F.col("end_i") - F.col("start_i") + 1).where(F.col("n_bars") >= least).drop("_s")


def trimmed(found: DataFrame, rows: DataFrame, measure: str, most: int = 12, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Segments longer than ``most`` bars cut to the ``most`` bars with the least mean of ``measure``, the first of equals."""
    w = Window.partitionBy(*keys).orderBy("bar_i").rowsBetween(0, most - 1)
    means = rows.select(*keys, "bar_i", F.avg(measure).over(w).alias("_mean"), F.count("*").over(w).alias("_n"))
    near = [F.col(f"s.{k}") == F.col(f"m.{k}") for k in keys]
    inside = (F.col("m.bar_i") >= F.col("s.start_i")) & (F.col("m.bar_i") + most - 1 <= F.col("s.end_i")) & (F.col("m._n") == most)
    long = found.where(F.col("n_bars") > most).alias("s").join(means.alias("m"), [*near, inside])
    best = long.groupBy(*(F.col(f"s.{k}") for k in keys), "s.start_i").agg(F.min_by("m.bar_i", F.struct("m._mean", "m.bar_i")).alias("_best"))
    out = found.join(best, [*keys, "start_i"], "left")
    cut = F.col("_best").isNotNull()
    return out.select(*keys, F.when(cut, F.col("_best")).otherwise(F.col("start_i")).alias("start_i"), F.when(cut, F.col("_best") + most - 1).otherwise(F.col("end_i")).alias("end_i")).withColumn("n_bars", F.col("end_i") - F.col("start_i") + 1)
