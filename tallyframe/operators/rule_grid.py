"""A grid of rules for dense segments, judged against boxes that are known: every cell of the grid in one scan of the bars."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that tell a cell.
CELL = ("fast_limit", "full_limit", "min_bars", "max_bars")


def swept_segments(bars: DataFrame, keys: Sequence[str], fast_limits: Sequence[float], full_limits: Sequence[float], min_bars: Sequence[int], max_bars: Sequence[int], fast: str = "fast_spread", full: str = "full_spread", merge_gap: int = 3) -> DataFrame:
    """(keys, CELL, start_i, end_i): for every cell the runs of bars with both measures at or below its limits, joined over up to
    ``merge_gap`` bars, of ``min_bars`` or more; of longer ones than ``max_bars`` that many bars with the least mean of
    ``full``, the first of equals. ``keys`` tell windows of bars, which are judged one by one.

    A bar is one row for each pair of limits that it meets; lengths are told apart afterwards, on segments. NULL measures
    meet no limit and take no part in a mean.
    """
    keys = list(keys)
    pairs = F.array(*(F.struct(F.lit(float(a)).alias("fast_limit"), F.lit(float(b)).alias("full_limit")) for a in fast_limits for b in full_limits))
    held = F.filter(pairs, lambda p: F.coalesce((F.col(fast) <= p["fast_limit"]) & (F.col(full) <= p["full_limit"]), F.lit(False)))
    hits = bars.select(*keys, "bar_i", F.explode(held).alias("p")).select(*keys, "bar_i", "p.*")
    w = Window.partitionBy(*keys, "fast_limit", "full_limit").orderBy("bar_i")
    begins = F.coalesce(F.col("bar_i") - F.lag("bar_i").over(w) > merge_gap + 1, F.lit(True))
    runs = hits.withColumn("_s", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "fast_limit", "full_limit", "_s").agg(F.min("bar_i").alias("start_i"), F.max("bar_i").alias("end_i")).drop("_s").withColumn("n", F.col("end_i") - F.col("start_i") + 1).where(F.col("n") >= min(min_bars))

    # the means of windows of each length, one row a bar; a long run meets those that lie inside it
    ahead = Window.partitionBy(*keys).orderBy("bar_i")
    means = bars.select(*keys, F.col("bar_i").alias("_at"), F.array(*(F.struct(F.lit(int(m)).alias("max_bars"), F.avg(full).over(ahead.rowsBetween(0, m - 1)).alias("mean")) for m in max_bars)).alias("means"))
    long = runs.where(F.col("n") > min(max_bars)).select(*keys, "start_i", "end_i", "n").distinct()
    asked = long.withColumn("_at", F.explode(F.sequence("start_i", F.col("end_i") - min(max_bars) + 1)))
    met = asked.join(means, [*keys, "_at"]).select(*keys, "start_i", "end_i", "n", "_at", F.explode("means").alias("m")).select(*keys, "start_i", "end_i", "n", "_at", "m.*")
    met = met.where((F.col("n") > F.col("max_bars")) & (F.col("_at") + F.col("max_bars") - 1 <= F.col("end_i")))
    best = met.groupBy(*keys, "start_i", "end_i", "max_bars").agg(F.min_by("_at", F.struct(F.col("mean").isNull(), "mean", "_at")).alias("_best"))
    each = runs.withColumn("max_bars", F.explode(F.array(*map(F.lit, max_bars)))).join(best, [*keys, "start_i", "end_i", "max_bars"], "left")
    start = F.coalesce("_best", "start_i")
    each = each.select(*keys, "fast_limit", "full_limit", "max_bars", "n", start.alias("start_i"), F.when(F.col("_best").isNotNull(), F.col("_best") + F.col("max_bars") - 1).otherwise(F.col("end_i")).alias("end_i"))
    kept = F.filter(F.array(*map(F.lit, min_bars)), lambda m: m <= F.col("n"))
    return each.withColumn("min_bars", F.explode(kept)).select(*keys, *CELL, "start_i", "end_i")


def boxed(segments: DataFrame, bars: DataFrame, keys: Sequence[str], averages: Sequence[str], pad: float = 0.25) -> DataFrame:
    """``segments`` with ``low`` and ``high``: the least and greatest average on their bars, and ``pad`` of their distance more on
    either side. Segments without averages are left out; each stretch of bars is looked up once, whatever cells have it."""
    keys = list(keys)
    some = segments.select(*keys, "start_i", "end_i").distinct()
    values = [F.col(a) for a in averages]
    on = bars.select(*keys, F.col("bar_i").alias("_at"), F.array_min(F.array(*values)).alias("_low"), F.array_max(F.array(*values)).alias("_high"))
    met = some.withColumn("_at", F.explode(F.sequence("start_i", "end_i"))).join(on, [*keys, "_at"]).groupBy(*keys, "start_i", "end_i").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).where("_low is not null")
    more = (F.col("_high") - F.col("_low")) * pad
    bounds = met.select(*keys, "start_i", "end_i", (F.col("_low") - more).alias("low"), (F.col("_high") + more).alias("high"))
    return segments.join(bounds, [*keys, "start_i", "end_i"])


def overlap_share(a: str, b: str) -> Column:
    """Intersection over union of boxes in bars and price; a box covers its bars whole."""
    c = lambda p, n: F.col(f"{p}{n}")
    wide = F.greatest(F.least(c(a, "end_i"), c(b, "end_i")) - F.greatest(c(a, "start_i"), c(b, "start_i")) + 1, F.lit(0))
    tall = F.greatest(F.least(c(a, "high"), c(b, "high")) - F.greatest(c(a, "low"), c(b, "low")), F.lit(0.0))
    area = lambda p: (c(p, "end_i") - c(p, "start_i") + 1) * (c(p, "high") - c(p, "low"))
    return F.coalesce(wide * tall / F.nullif(area(a) + area(b) - wide * tall, F.lit(0.0)), F.lit(0.0))


def cell_scores(boxes: DataFrame, truth: DataFrame, keys: Sequence[str], part: str, least: float = 0.3) -> DataFrame:
    """(CELL, part, tp, fp, fn, precision, recall, f1) of every cell that has a box, for each value of ``part``, a column of the
    truth's and the boxes' windows. In a window the true boxes choose in their order, each the first free box that overlaps
    by ``least``. Only overlapping pairs go to the tasks, dealt by cell and window."""
    keys = list(keys)
    bound = ("start_i", "end_i", "low", "high")
    a = truth.select(*keys, *(F.col(c).alias(f"t_{c}") for c in bound))
    b = boxes.select(*keys, *bound).distinct().select(*keys, *(F.col(c).alias(f"b_{c}") for c in bound))
    near = a.join(b, keys).where((F.col("t_start_i") <= F.col("b_end_i")) & (F.col("b_start_i") <= F.col("t_end_i")))
    near = near.where(overlap_share("t_", "b_") >= least).select(*keys, "t_start_i", F.col("b_start_i").alias("start_i"), F.col("b_end_i").alias("end_i"))
    pairs = boxes.select(*keys, part, *CELL, "start_i", "end_i").join(near, [*keys, "start_i", "end_i"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        hits, taken, done = 0, set(), set()
        for t, s in frame[["t_start_i", "start_i"]].sort_values(["t_start_i", "start_i"]).itertuples(index=False):
            if t not in done and s not in taken:
                done.add(t)
                taken.add(s)
                hits += 1
        return frame[[part, *CELL]].head(1).assign(tp=hits)

    kinds = dict(pairs.dtypes)
    found = pairs.groupBy(*keys, part, *CELL).applyInPandas(run, f"{', '.join(f'`{c}` {kinds[c]}' for c in (part, *CELL))}, tp long")
    hits = found.groupBy(part, *CELL).agg(F.sum("tp").alias("tp"))
    totals = boxes.groupBy(part, *CELL).agg(F.count("*").alias("n_found")).join(F.broadcast(truth.groupBy(part).agg(F.count("*").alias("n_truth"))), part, "left").join(hits, [part, *CELL], "left").na.fill(0, ["tp", "n_truth"])
    rate = lambda n: F.round(F.col("tp") / F.greatest(F.col(n), F.lit(1)), 3)
    return totals.select(*CELL, part, "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), rate("n_found").alias("precision"), rate("n_truth").alias("recall"), F.round(2 * F.col("tp") / F.greatest(F.col("n_found") + F.col("n_truth"), F.lit(1)), 4).alias("f1"))


def best_cells(scores: DataFrame, part: str, fit: object, top: int = 5) -> DataFrame:
    """The ``top`` cells by f1 on the part ``fit``, equals by cell, with place, and what they reach on all parts."""
    chosen = scores.where(F.col(part) == F.lit(fit)).orderBy(F.desc("f1"), *CELL).limit(top)
    placed = chosen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), *CELL))).select(*CELL, "place")
    return scores.join(F.broadcast(placed), list(CELL))
