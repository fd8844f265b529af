"""Columns over a series' ordered bars: rolling statistics, runs, ranks and null-safe arithmetic.

A missing value is NULL. A rolling statistic is NULL until ``least`` values of its window are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("symbol",)


def series(*keys: str, order: str = "bar_i") -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES)).orderBy(order)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sdiv(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def finite(x: Column | str) -> Column:
    """NaN and infinities as NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def true(condition: Column) -> Column:
    """NULL as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return true(condition).cast("int")


def lag(x: Column | str, k: int, w: WindowSpec) -> Column:
    return F.lag(col(x), k).over(w)


def change(x: Column | str, k: int, w: WindowSpec) -> Column:
    """Relative change over k bars."""
    return sdiv(x, lag(x, k, w)) - 1


def rolling(f, x: Column | str, n: int, w: WindowSpec, least: int | None = None, shift: int = 0) -> Column:
    """``f`` over the last ``n`` bars (ending ``shift`` bars ago), NULL below ``least`` values (all ``n`` by default)."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(col(x)).over(frame) >= (n if least is None else least), f(col(x)).over(frame))


def rolling_corr(x: Column | str, y: Column | str, n: int, w: WindowSpec) -> Column:
    """Correlation by moments; NULL where either side doesn't vary."""
    frame = w.rowsBetween(-(n - 1), 0)
    x, y = col(x), col(y)
    whole = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(frame) == n
    return F.when(whole, sdiv(F.covar_samp(x, y).over(frame), F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)))


def rolling_skew(x: Column | str, n: int, w: WindowSpec) -> Column:
    """Bias-corrected skewness of a full window."""
    return rolling(F.skewness, x, n, w) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))


def ts_rank(x: Column | str, n: int, w: WindowSpec) -> Column:
    """The part of the last n values that are at most the last one; NULL until n are there."""
    x = col(x)
    held = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    return F.when(F.size(held) == n, F.size(F.filter(held, lambda v: v <= x)) / F.lit(float(n)))


def run_length(condition: Column, w: WindowSpec) -> Column:
    """Bars in a row, up to this one, for which the condition holds: those since the last one for which it doesn't."""
    at = F.row_number().over(w)
    last = F.max(F.when(~true(condition), at)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return at - F.coalesce(last, F.lit(0))


def position(x: Column | str, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Where x stands between the least and the greatest of its last n values."""
    low, high = rolling(F.min, x, n, w, least), rolling(F.max, x, n, w, least)
    return sdiv(col(x) - low, high - low)


def filled(x: Column | str, limit: int, w: WindowSpec) -> Column:
    """The last value of at most ``limit`` bars ago where x is missing."""
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(-limit, 0))


def average_rank(x: Column | str, *keys: str) -> Column:
    """Rank with ties averaged, inside groups that fit in one task; NULL for missing values, which take no rank."""
    x = col(x)
    kept = F.when(x.isNotNull(), 1)
    w = Window.partitionBy(*keys)
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x.asc_nulls_last())) + (F.count(kept).over(w.partitionBy(*keys, x)) - 1) / 2)


def with_average_rank(rows: DataFrame, x: str, into: str, keys: tuple[str, ...] = (), buckets: int = 256) -> DataFrame:
    """``rows`` with the rank of ``x``, ties averaged, over the whole table or within ``keys`` of any size; and ``<into>_n``, the
    number of ranked rows. NULLs take no rank.

    Approximate quantiles (``buckets`` numbers a key, broadcast) cut the values into ranges; a rank is the number of rows in
    the ranges before plus the rank inside the range, so no task holds more than a range, or the rows of one value.
    """
    value = F.col(x).cast("double")
    whole, rows = not keys, rows if keys else rows.withColumn("_one", F.lit(1))
    keys = keys or ("_one",)
    cuts = [k / buckets for k in range(1, buckets)]
    bounds = rows.where(value.isNotNull()).groupBy(*keys).agg(F.approx_percentile(value, cuts, 10_000).alias("_bounds"), F.count("*").alias(into + "_n"))
    met = rows.join(F.broadcast(bounds), list(keys), "left")
    met = met.withColumn("_range", F.when(value.isNotNull(), F.size(F.filter("_bounds", lambda b: b < value)))).drop("_bounds")
    totals = met.where(F.col("_range").isNotNull()).groupBy(*keys, "_range").agg(F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_range", before.alias("_before"))
    # ranks come from the counts of the values, so that a value many rows share is no burden
    values = met.where(F.col("_range").isNotNull()).groupBy(*keys, "_range", value.alias("_value")).agg(F.count("*").alias("_ties"))
    below = F.coalesce(F.sum("_ties").over(Window.partitionBy(*keys, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("_below", below).join(F.broadcast(totals), [*keys, "_range"])
    values = values.select(*keys, "_value", (F.col("_before") + F.col("_below") + 1 + (F.col("_ties") - 1) / 2).alias(into))
    return met.drop("_range").withColumn("_value", value).join(values, [*keys, "_value"], "left").drop("_value", *(["_one"] if whole else []))


def micros(df: DataFrame, name: str) -> Column:
    """A column of times as microseconds; numbers stay as they are."""
    return F.unix_micros(F.col(name).cast("timestamp")) if dict(df.dtypes)[name] in ("timestamp", "timestamp_ntz", "date") else F.col(name).cast("long")


#: Microseconds of the stretches into which ordered rows of one key are cut.
STRETCH = 86_400_000_000


def with_running_sums(rows: DataFrame, keys: list[str], time: str, sums: dict[str, str], stretch: int = STRETCH) -> DataFrame:
    """``rows``, one a key and time, with the sum of each value (name -> new name) up to each. Sums run inside stretches of
    time and over the stretches' totals, so that no task holds a whole key."""
    cut = rows.withColumn("_stretch", F.floor(micros(rows, time) / F.lit(stretch)))
    totals = cut.groupBy(*keys, "_stretch").agg(*(F.sum(v).alias(f"_total_{n}") for v, n in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_stretch", *(F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums.values()))
    w = Window.partitionBy(*keys, "_stretch").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"_inside_{n}": F.sum(v).over(w) for v, n in sums.items()}).join(totals, [*keys, "_stretch"])
    return inside.withColumns({n: F.col(f"_inside_{n}") + F.col(f"_before_{n}") for n in sums.values()}).drop("_stretch", *(f"{x}_{n}" for n in sums.values() for x in ("_inside", "_before")))


def weekday(ts: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(col(ts))
