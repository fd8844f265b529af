"""Rank tests of two kinds of rows, for each of many groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import sdiv
from ..sources.staging import staged
from .quantiles import quantiles_of_counts, with_counts_below

#: Steps of the series and the continued fraction behind the normal distribution's tail; both are exact to a double.
STEPS = 100


def erfc(x: Column) -> Column:
    """The complementary error function of values from 0 on: one less the series below 2, the continued fraction above."""
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    term = F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum"))

    def added(s: Column, k: Column) -> Column:
        t = s["term"] * 2 * x * x / (2 * k + 1)
        return F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))

    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * F.aggregate(steps, term, added)["sum"]
    far = F.exp(-x * x) / (math.sqrt(math.pi) * F.aggregate(F.reverse(steps), x.cast("double"), lambda t, k: x + k / 2 / t))
    return F.when(x < 2, near).otherwise(far)


def two_sided(z: Column) -> Column:
    """How likely a standard normal value is to lie as far from 0 on either side."""
    return F.least(erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2.0)), F.lit(1.0))


def mann_whitney(rows: DataFrame, label: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_pos, n_neg, median_pos, median_neg, u, rank_biserial, z, p_value): whether values of label 1 tend to be greater
    than those of label 0 in each group.

    ``u`` counts the pairs in which the positive is greater, ties as half; rank_biserial is 2 u / pairs - 1; z has the
    correction for ties and for continuity, and p is two-sided. Rows without a label or value (NULL or NaN) take no part;
    a group without rows of both labels has NULLs, and one whose values are all equal has no z and a p of 1.

    All comes from the counts of distinct values, which are written to the shared folder and ordered in ranges: no task
    holds a group.
    """
    x, y = F.col(value).cast("double"), F.col(label).cast("int")
    keys = list(keys)
    rows = rows if keys else rows.withColumn("_all", F.lit(1))
    own = keys or ["_all"]
    usable = rows.where(x.isNotNull() & ~F.isnan(x) & y.isin(0, 1)).select(*own, (x + F.lit(0.0)).alias("_x"), y.alias("_y"))
    counts = staged(usable.groupBy(*own, "_x").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q")), "counts")
    below = with_counts_below(counts, "_x", {"_q": "_below"}, own)
    ties = F.col("_p") + F.col("_q")
    whole = lambda c: c.cast("double")
    found = below.groupBy(*own).agg(
        F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("u"), F.sum(whole(ties) * whole(ties) * whole(ties) - ties).alias("_ties")
    )
    n, pairs = F.col("n_pos") + F.col("n_neg"), whole(F.col("n_pos")) * F.col("n_neg")
    spread = F.sqrt(pairs / 12 * (n + 1 - sdiv(F.col("_ties"), n * (n - 1))))
    z = sdiv(F.greatest(F.col("u"), pairs - F.col("u")) - pairs / 2 - 0.5, spread)
    found = found.withColumn("_both", pairs > 0).withColumn("z", F.when(F.col("_both"), z)).withColumn("rank_biserial", F.when(F.col("_both"), 2 * F.col("u") / pairs - 1))
    found = found.withColumn("p_value", F.when(F.col("_both"), F.coalesce(two_sided(F.col("z")), F.lit(1.0)))).withColumn("u", F.when(F.col("_both"), F.col("u")))
    by_label = counts.select(*own, "_x", F.explode(F.create_map(F.lit(1), "_p", F.lit(0), "_q")).alias("_y", "_c"))
    medians = quantiles_of_counts(by_label, "_x", "_c", [0.5], [*own, "_y"]).groupBy(*own).agg(*(F.max(F.when(F.col("_y") == k, F.col("value"))).alias(f"median_{s}") for k, s in ((1, "pos"), (0, "neg"))))
    other = medians.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(own)})
    test = None
    for i, k in enumerate(own):
        one = F.col(k).eqNullSafe(F.col(f"_r{i}"))
        test = one if test is None else test & one
    return found.join(other, test).select(*keys, "n_pos", "n_neg", "median_pos", "median_neg", "u", "rank_biserial", "z", "p_value")
