"""Exact quantiles of large groups by selection: values are counted between pivots, round by round, until few are left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Pivots of a round: about evenly spaced distinct values.
PIVOTS = 128


def exact_quantiles(rows: DataFrame, value: str, quantiles: Sequence[float], keys: Sequence[str] = (), into: str = "value", rounds: int = 2) -> DataFrame:
    """(keys, quantile, into, n): quantiles of each group, linear between neighbours; n counts the values.

    NULLs and NaNs take no part; groups without other values have no rows, nor has an empty table. NULL keys are a group.

    Rows are counted by group and value, the counts are written to the shared folder, and all else is done on them. The
    ranks asked for are narrowed down to the values between two of ``PIVOTS`` pivots, ``rounds`` times; what is left, a
    part of about PIVOTS^-rounds of the group's distinct values for every rank, is ordered. So no task holds a group's
    values, and one that many rows share is no burden. The driver sees nothing.
    """
    x = F.col(value).cast("double")
    counts = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, (x + F.lit(0.0)).alias("_x")).agg(F.count("*").alias("_c"))  # one zero
    return quantiles_of_counts(staged(counts, "counts"), "_x", "_c", quantiles, keys, into, rounds)


def quantiles_of_counts(counts: DataFrame, value: str, count: str, quantiles: Sequence[float], keys: Sequence[str] = (), into: str = "value", rounds: int = 2) -> DataFrame:
    """``exact_quantiles`` of a table that has one row a group and value, which is read several times."""
    if not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("a quantile lies between 0 and 1")
    names = [f"_k{i}" for i in range(len(keys))]
    group = F.xxhash64(F.to_json(F.struct(*keys))) if names else F.lit(0).cast("long")  # dealt by one column; met by all
    counts = counts.where(F.col(count) > 0).select(group.alias("g"), *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).alias("x"), F.col(count).alias("c"))
    sizes = counts.groupBy("g", *names).agg(F.sum("c").alias("n"))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    asked = sizes.select("g", *names, "n", F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), place(q).alias("at")) for q in quantiles))).alias("a")).select("g", *names, "n", "a.*")
    low = F.floor("at").cast("long")
    asked = asked.withColumn("low", low).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1)).withColumn("part", F.col("at") - F.col("low"))
    ranks = asked.select("g", *names, F.explode(F.array("low", "high")).alias("rank")).distinct().withColumn("left", F.col("rank"))

    same = ["g", *names]
    held = counts  # (g, names, x, c), in later rounds one row for each rank as well
    for k in range(rounds):
        own = same if k == 0 else [*same, "rank"]
        cuts = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
        pivots = held.groupBy(*own).agg(F.array_distinct(F.approx_percentile("x", cuts, 4 * PIVOTS)).alias("pivots"))
        dealt = _met(held, pivots, own).withColumn("between", F.size(F.filter("pivots", lambda p: p < F.col("x")))).drop("pivots")
        totals = dealt.groupBy(*own, "between").agg(F.sum("c").alias("total"))
        before = F.coalesce(F.sum("total").over(Window.partitionBy(*own).orderBy("between").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        totals = totals.withColumn("before", before)
        found = _met(ranks, totals, own).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("total")))
        ranks = found.select(*same, "rank", (F.col("left") - F.col("before")).alias("left"), "between")
        held = _met(dealt, ranks.select(*same, "rank", "between", "left") if k == 0 else ranks, [*own, "between"]).select(*same, "rank", "x", "c", "left")
        ranks = ranks.drop("between")
        if k + 1 < rounds:
            held = held.drop("left")
    until = F.sum("c").over(Window.partitionBy(*same, "rank").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    last = held.withColumn("until", until).where((F.col("until") > F.col("left")) & (F.col("until") - F.col("c") <= F.col("left"))).select(*same, "rank", "x")
    a = _met(asked, last.select(*same, F.col("rank").alias("low"), F.col("x").alias("a")), [*same, "low"])
    both = _met(a, last.select(*same, F.col("rank").alias("high"), F.col("x").alias("b")), [*same, "high"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    return both.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.col("q").alias("quantile"), between.alias(into), "n")


def _met(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: str = "_k") -> DataFrame:
    """An inner join in which the keys whose names begin with ``null_safe`` meet where both are NULL."""
    other = right.select(*(F.col(c).alias(f"_r{c}") if c in on else F.col(c) for c in right.columns))
    left = left.drop(*(c for c in right.columns if c not in on))
    test = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r{c}")) if c.startswith(null_safe) else F.col(c) == F.col(f"_r{c}")
        test = one if test is None else test & one
    return left.join(other, test).drop(*(f"_r{c}" for c in on))


def with_counts_below(counts: DataFrame, x: str, sums: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """``counts``, one row a key and value of ``x``, with the sum of each column (name -> new name) over the key's smaller values.

    Pivots cut the values of a key into ranges; a sum is that of the ranges before plus that inside the range, so no task
    holds a key. Values aren't NULL, keys may be.
    """
    cuts = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
    pivots = counts.groupBy(*keys).agg(F.array_distinct(F.approx_percentile(x, cuts, 4 * PIVOTS)).alias("_pivots"))
    dealt = _met(counts, pivots, keys, "").withColumn("_between", F.size(F.filter("_pivots", lambda p: p < F.col(x)))).drop("_pivots")
    totals = dealt.groupBy(*keys, "_between").agg(*(F.sum(c).alias(f"_total{i}") for i, c in enumerate(sums)))
    earlier = Window.partitionBy(*keys).orderBy("_between").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_between", *(F.coalesce(F.sum(f"_total{i}").over(earlier), F.lit(0)).alias(f"_before{i}") for i in range(len(sums))))
    inside = Window.partitionBy(*keys, "_between").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    met = _met(dealt.withColumns({f"_inside{i}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, c in enumerate(sums)}), totals, [*keys, "_between"], "")
    return met.withColumns({n: F.col(f"_inside{i}") + F.col(f"_before{i}") for i, n in enumerate(sums.values())}).drop("_between", *(f"{m}{i}" for i in range(len(sums)) for m in ("_inside", "_before")))


def quantile_table(rows: DataFrame, value: str, named: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """One row a group: each quantile of ``named`` in a column of its name, and ``n``."""
    found = exact_quantiles(rows, value, sorted(set(named.values())), keys)
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(c) for c, q in named.items()))
