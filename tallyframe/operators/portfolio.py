"""Replays of signals under capacity: which trades a portfolio would have held.

Choices depend on what is open, so a replay is sequential. It is cut where it can be: at every moment when no signal so
far can still be open, whatever was taken, the state is empty, and what follows is a replay of its own.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _episodes(signals: DataFrame) -> DataFrame:
    """Numbers the stretches of signals between two moments when nothing could be open."""
    w = Window.partitionBy(F.lit(0)).orderBy("entry_time", "exit_time")
    spans = signals.groupBy("entry_time").agg(F.max("exit_time").alias("exit_time"))  # one row a moment
    before = F.max("exit_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_new", F.coalesce(before <= F.col("entry_time"), F.lit(True)).cast("int"))
    fresh = fresh.select("entry_time", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_episode"))
    return signals.join(fresh, "entry_time")


def replay(signals: DataFrame, threshold: float, slots: float = 10, keys: tuple[str, ...] = ("symbol",), weight: str | None = None) -> DataFrame:
    """The signals taken: score at least ``threshold``, one position a key, ``slots`` at once (or, with ``weight``, so
    much weight), the better score first among those of one moment. A position that exits at a moment is free then.

    Signals without entry, exit or score are left out; of equal scores the key first by name goes first.
    """
    eligible = signals.where((F.col("score") >= threshold) & F.col("entry_time").isNotNull() & F.col("exit_time").isNotNull())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_s=-frame["score"]).sort_values(["entry_time", "_s", *keys], kind="stable").drop(columns="_s").reset_index(drop=True)
        open_: list[tuple] = []
        held: set[tuple] = set()
        used, taken = 0.0, []
        for k, row in enumerate(frame.itertuples(index=False)):
            while open_ and open_[0][0] <= row.entry_time:
                _, _, key, w = heapq.heappop(open_)
                held.discard(key)
                used -= w
            key = tuple(getattr(row, c) for c in keys)
            w = 1.0 if weight is None else float(getattr(row, weight))
            if key not in held and w > 0 and used + w <= slots + 1e-9:
                heapq.heappush(open_, (row.exit_time, k, key, w))
                held.add(key)
                used += w
                taken.append(k)
        return frame.iloc[taken].drop(columns="_episode")

    return _episodes(eligible).groupBy("_episode").applyInPandas(run, signals.select("entry_time", *(c for c in signals.columns if c != "entry_time")).schema).select(signals.columns)


def cool_down(signals: DataFrame, bars: int = 4, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades of each key one after the other, the next at least ``bars`` bars after the last exit (column exit_i)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept, free = [], None
        frame = frame.sort_values("bar_i", kind="stable")
        for k, (at, end) in enumerate(zip(frame["bar_i"], frame["exit_i"], strict=True)):
            if free is None or at >= free:
                kept.append(k)
                free = end + bars
        return frame.iloc[kept].drop(columns="_episode")

    w = Window.partitionBy(*keys).orderBy("bar_i")
    before = F.max(F.col("exit_i") + bars).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = signals.withColumn("_new", F.coalesce(before <= F.col("bar_i"), F.lit(True)).cast("int")).withColumn("_episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return cut.groupBy(*keys, "_episode").applyInPandas(run, signals.schema)
