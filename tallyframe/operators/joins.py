"""As-of, range and nearest joins of ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import STRETCH, micros, with_running_sums


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False, stretch: int = STRETCH) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` at or before its time (before it, if ``strict``), of
    equal keys; NULL where there is none.

    One union and one window over each key's stretches of time (in microseconds, or the unit of numeric times); what the
    stretches before one end with comes from the table of the stretches that have rows. No window holds a whole key. Of
    right rows with equal times the one with the greatest values counts. Left rows without a time or key meet nothing, nor
    do right rows.
    """
    own = F.struct(*(F.col(c) for c in left.columns))
    found = F.struct(*(F.col(c) for c in columns))
    known = right.where(F.col(right_time).isNotNull()).dropna(subset=keys)
    a = left.select(*keys, micros(left, left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), own.alias("_own"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_found"))
    b = known.select(*keys, micros(right, right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_own"].dataType).alias("_own"), found.alias("_found"))
    rows = a.unionByName(b).withColumn("_stretch", F.floor(F.col("_t") / F.lit(stretch)))
    ends = rows.dropna(subset=[*keys, "_stretch"]).groupBy(*keys, "_stretch").agg(F.max(F.when(F.col("_own").isNull(), F.struct("_t", "_found"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(earlier)["_found"].alias("_carried"))
    w = Window.partitionBy(*keys, "_stretch").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_found").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_own is not null")
    met = met.join(carried, [*keys, "_stretch"], "left")
    some = F.when(F.col("_t").isNotNull(), F.coalesce("_last", "_carried"))
    return met.withColumn("_met", some).select("_own.*", *(F.col(f"_met.{c}").alias(c) for c in columns))


def next_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """``left`` with the ``columns`` of the first row of ``right`` at or after its time."""
    met = asof_join(left.withColumn("_lt", -micros(left, left_time)), right.withColumn("_rt", -micros(right, right_time)), keys, "_lt", "_rt", columns)
    return met.drop("_lt")


def range_sums(trades: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, time: str, sums: dict[str, str], coverage: bool = True) -> DataFrame:
    """``trades`` with the sum of each value (name -> new name) over the events in (start, end].

    From running sums and two as-of joins, so that the cost doesn't grow with the events in a range. An event counts if none
    of its values is missing. With ``coverage`` the sums are NULL where the history lies wholly outside the trade: it ends before the
    trade starts or starts after it ends; a trade that the history covers in part gets the sum of that part.
    """
    known = events.where(F.col(time).isNotNull())
    for v in sums:
        known = known.where(F.col(v).isNotNull())
    each = known.groupBy(*keys, time).agg(*(F.sum(v).alias(f"_v_{n}") for v, n in sums.items()))
    run = with_running_sums(each, keys, time, {f"_v_{n}": f"_run_{n}" for n in sums.values()})
    ends = lambda mark: run.select(*keys, time, *(F.col(f"_run_{n}").alias(f"{mark}_{n}") for n in sums.values()))
    met = asof_join(trades, ends("_a"), keys, start, time, [f"_a_{n}" for n in sums.values()])
    met = asof_join(met, ends("_b"), keys, end, time, [f"_b_{n}" for n in sums.values()])
    covered = F.lit(True)
    if coverage:
        met = met.join(each.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last")), keys, "left")
        covered = (F.col("_first") <= F.col(end)) & (F.col("_last") >= F.col(start))
    zero = F.lit(0.0)
    met = met.withColumns({n: F.when(covered, F.coalesce(f"_b_{n}", zero) - F.coalesce(f"_a_{n}", zero)) for n in sums.values()})
    return met.drop("_first", "_last", *(f"{m}_{n}" for n in sums.values() for m in ("_a", "_b")))


def range_sum(trades: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, time: str, value: str, into: str, coverage: bool = True) -> DataFrame:
    """``range_sums`` of one value."""
    return range_sums(trades, events, keys, start, end, time, {value: into}, coverage)


def nearest_seconds(left: DataFrame, right: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``left`` with ``nearest_s``, the seconds to the nearest row of ``right`` of equal keys; NULL without one."""
    before = asof_join(left, right.select(*keys, F.col(time).alias("_before")), keys, time, "_before", ["_before"])
    both = next_join(before, right.select(*keys, F.col(time).alias("_after")), keys, time, "_after", ["_after"])
    gap = F.least(micros(both, time) - micros(both, "_before"), micros(both, "_after") - micros(both, time))
    return both.withColumn("nearest_s", gap / 1e6).drop("_before", "_after")


def nearest_anti(left: DataFrame, right: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """Rows of ``left`` without a row of ``right`` within so many seconds."""
    return nearest_seconds(left, right, keys, time).where((F.col("nearest_s") > seconds) | F.col("nearest_s").isNull()).drop("nearest_s")


def overlap(a: DataFrame, b: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """One row: rows of each side, those with a partner within so many seconds, recall, precision and the median distance."""
    one = nearest_seconds(a, b, keys, time).agg(F.count("*").alias("n_a"), F.count_if(F.col("nearest_s") <= seconds).alias("hit_a"), F.percentile(F.when(F.col("nearest_s") <= seconds, F.col("nearest_s")), F.lit(0.5)).alias("median_s"))
    two = nearest_seconds(b, a, keys, time).agg(F.count("*").alias("n_b"), F.count_if(F.col("nearest_s") <= seconds).alias("hit_b"))
    both = one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    rate = lambda x, n: F.col(x) / F.nullif(F.col(n), F.lit(0))
    return both.withColumns({"recall": rate("hit_a", "n_a"), "precision": rate("hit_b", "n_b")})


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: keys in both tables, in one only, and those whose values differ by more than the tolerance."""
    left = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    right = b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    met = left.join(right, keys, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return met.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("_in_b").isNull()).alias("only_a"), F.count_if(F.col("_in_a").isNull()).alias("only_b"),
        F.count_if(both & (F.abs(F.col("_a") - F.col("_b")) > tolerance)).alias("n_different"),
    )


def flagged(rows: DataFrame, other: DataFrame, keys: list[str], into: str) -> DataFrame:
    """``rows`` with whether ``other`` has their key."""
    seen = other.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, keys, "left").withColumn(into, F.coalesce("_seen", F.lit(False))).drop("_seen")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, Column | object] | None = None) -> DataFrame:
    """A left join that raises where ``right`` repeats a key, missing columns filled with ``defaults``."""
    w = Window.partitionBy(*keys)
    once = right.withColumn("_n", F.count("*").over(w)).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("a key of the right side repeats")))
    met = left.join(once.where("_ok is null").drop("_n", "_ok"), keys, "left")
    for c, v in (defaults or {}).items():
        met = met.withColumn(c, F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)))
    return met
