"""Arms and hits: a bar arms a series, and within some bars after it the first bar that meets a condition is a hit.

A grid of thresholds is many machines over the same bars. As an arm lasts until the next one or for ``wait`` bars, its bars
are a group, and the first hits of all conditions are aggregates of it: one pass, however many conditions there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import true
from .selection import min_gap


def armed_hits(bars: DataFrame, arm: Column, hits: Mapping[str, tuple[Column, Column]], wait: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, armed_i, hit, bar_i, side): for every arm and each of ``hits`` (name -> condition and side) the first bar after
    the arm, at most ``wait`` bars later and before the next arm ends it, for which the condition holds.

    A bar that arms isn't a hit of the arm before. What the condition says of side is kept as it is at that bar: a hit on
    one side uses up its arm also for a user who wants the other, so filter sides afterwards; put the side into the
    condition where only hits on that side are to use up the arm. NULL conditions are false; an arm without a hit of some
    name has no row for it.
    """
    w = Window.partitionBy(*keys).orderBy("bar_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("armed_i", F.max(F.when(true(arm), F.col("bar_i"))).over(w))
    inside = rows.where((F.col("bar_i") > F.col("armed_i")) & (F.col("bar_i") <= F.col("armed_i") + wait))
    firsts = inside.groupBy(*keys, "armed_i").agg(
        F.array(*(F.struct(F.lit(name).alias("hit"), F.min(F.when(true(test), F.struct("bar_i", side.cast("int").alias("side")))).alias("at")) for name, (test, side) in hits.items())).alias("firsts")
    )
    each = firsts.select(*keys, "armed_i", F.explode("firsts").alias("f")).where("f.at is not null")
    return each.select(*keys, "armed_i", "f.hit", "f.at.bar_i", "f.at.side")


def arms(bars: DataFrame, arm: Column, side: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The arms themselves as hits of their own bar."""
    return bars.where(true(arm)).select(*keys, F.col("bar_i").alias("armed_i"), F.col("bar_i"), side.cast("int").alias("side")).where("side is not null")


def threshold_grid(bars: DataFrame, arm: Column, measure: Column, side: Column, confirmed: Column, thresholds: Sequence[float], confirmed_thresholds: Sequence[float], wait: int, want: int = -1, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, family, threshold, armed_i, bar_i): hits on the side ``want`` of two families over their thresholds of ``measure``.

    ``first``: the first bar whose measure reaches the threshold, whatever its side, uses up the arm; it is a row if its side
    is wanted. ``confirmed``: the first bar on the wanted side that reaches it and is confirmed as well; bars of the other
    side use up nothing.
    """
    name = lambda family, t: f"{family}@{t!r}"
    hits = {name("first", t): (measure >= t, side) for t in thresholds}
    hits |= {name("confirmed", t): ((measure >= t) & (side == want) & confirmed, side) for t in confirmed_thresholds}
    found = armed_hits(bars, arm, {n: (test & side.isNotNull(), s) for n, (test, s) in hits.items()}, wait, keys).where(F.col("side") == want)
    parts = F.split("hit", "@")
    return found.select(*keys, parts[0].alias("family"), parts[1].cast("double").alias("threshold"), "armed_i", "bar_i")


def counted_grid(found: DataFrame, gaps: Sequence[int], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(family, threshold, gap, n): hits that are left when those of a series must be ``gap`` bars apart, for each gap."""
    out = None
    for gap in gaps:
        kept = min_gap(found, gap, (*keys, "family", "threshold")).groupBy("family", "threshold").agg(F.count("*").alias("n")).withColumn("gap", F.lit(gap))
        out = kept if out is None else out.unionByName(kept)
    return out.select("family", "threshold", "gap", "n")


def picked_config(counted: DataFrame, low: int, high: int, aim: int, base_gap: int, base_threshold: float) -> DataFrame:
    """One row a family: of the (threshold, gap) cells with ``low`` to ``high`` hits, those that raise the base threshold alone
    come first, then those that raise the base gap alone, then those that raise both, then the others; among them the
    count closest to ``aim``, then the smaller threshold and gap. A family without such a cell takes the count closest to
    the aim of all; ``in_band`` tells which."""
    in_band = F.col("n").between(low, high)
    more, wider = F.col("threshold") > base_threshold + 1e-12, F.col("gap") > base_gap
    kind = F.when(more & (F.col("gap") == base_gap), 0).when((F.abs(F.col("threshold") - base_threshold) < 1e-12) & wider, 1).when(more & wider, 2).otherwise(3)
    order = F.struct((~in_band).cast("int"), F.when(in_band, kind).otherwise(0), F.abs(F.col("n") - aim), "threshold", "gap")
    return counted.groupBy("family").agg(F.min_by(F.struct("threshold", "gap", "n", in_band.alias("in_band")), order).alias("x")).select("family", "x.*")
