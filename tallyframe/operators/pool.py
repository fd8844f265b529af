"""A pool of symbols filled in order from several ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The lists in the order in which they fill the pool; the first two are its core.
SIDES = ("major", "volume", "gain", "loss")


def scan_pool(tickers: DataFrame, pinned: Sequence[str], volume_top: int, top: int, least_volume: float, losses: bool = True, most: int | None = None) -> DataFrame:
    """(symbol, side, rank, change, volume): the pinned symbols that are listed, in their order; those of most volume without
    the pinned; of symbols with ``least_volume`` the greatest gains and, with ``losses``, the greatest losses.

    A symbol stays in the first list that has it, and the others keep the ranks that they had with it. ``most`` cuts the
    pool from its end, movers before the core. Equals go by symbol; rows without a symbol, change or volume are left out;
    tickers hold a symbol once (columns symbol, change, volume). Every list is a top-k of its own, so what is ranked and
    deduplicated together has at most as many rows as the lists allow.
    """
    rows = tickers.where(F.col("symbol").isNotNull() & F.col("change").isNotNull() & F.col("volume").isNotNull()).select("symbol", F.col("change").cast("double").alias("change"), F.col("volume").cast("double").alias("volume"))
    place = F.array_position(F.array(*map(F.lit, pinned)), F.col("symbol")) if pinned else F.lit(0)
    is_pinned = place > 0

    def ranked(side: str, some: DataFrame, order: list, n: int) -> DataFrame:
        few = some.orderBy(*order).limit(n)
        return few.withColumn("side", F.lit(SIDES.index(side))).withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    first = rows.where(is_pinned).withColumn("rank", place.cast("int")).withColumn("side", F.lit(0))
    lists = [first, ranked("volume", rows.where(~is_pinned), [F.desc("volume"), "symbol"], max(1, volume_top))]
    liquid = rows.where(F.col("volume") >= least_volume)
    lists.append(ranked("gain", liquid, [F.desc("change"), "symbol"], top))
    if losses:
        lists.append(ranked("loss", liquid, [F.asc("change"), "symbol"], top))
    every = lists[0].select("symbol", "change", "volume", "side", "rank")
    for more in lists[1:]:
        every = every.unionByName(more)
    pool = every.groupBy("symbol").agg(F.min_by(F.struct("side", "rank", "change", "volume"), F.struct("side", "rank")).alias("x")).select("symbol", "x.*")
    pool = pool if most is None else pool.orderBy("side", "rank").limit(max(1, most))
    return pool.select("symbol", F.get(F.array(*map(F.lit, SIDES)), F.col("side")).alias("side"), F.col("rank").cast("int").alias("rank"), "change", "volume")
