"""The state of a leading market, looked up by the moment, and buckets of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import rolling, sdiv, series, true

# Bars of the mean range, of its median and the least of those, and the change that makes a trend.
RANGE_BARS, MEDIAN_BARS, LEAST_BARS, TREND = 14, 500, 100, 0.03


def rolling_median(x: str, n: int, least: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """The median of the last n values, NULL below ``least``."""
    held = F.array_sort(F.collect_list(x).over(series(*keys).rowsBetween(-(n - 1), 0)))
    size = F.size(held)
    middle = (F.get(held, F.floor((size - 1) / 2).cast("int")) + F.get(held, F.floor(size / 2).cast("int"))) / 2
    return F.when(size >= least, middle)


def volatility_regime(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, open_time, range_pct, high): whether a bar's mean relative range is above its own trailing median."""
    rows = bars.withColumn("range_pct", rolling(F.avg, sdiv(F.col("high") - F.col("low"), "close"), RANGE_BARS, series(*keys)))
    rows = rows.withColumn("_median", rolling_median("range_pct", MEDIAN_BARS, LEAST_BARS, keys))
    return rows.select(*keys, "open_time", "range_pct", true(F.col("range_pct") > F.col("_median")).cast("double").alias("high"))


def with_state(rows: DataFrame, states: DataFrame, time: str, into: str, state_time: str = "open_time", state: str = "high", default: float = 0.0) -> DataFrame:
    """``rows`` with the state of exactly their moment, ``default`` where there is none. ``states`` has one row a moment."""
    known = states.select(F.col(state_time).alias(time), F.col(state).alias(into))
    return rows.join(known, time, "left").withColumn(into, F.coalesce(into, F.lit(default)))


def trend_bucket(change: Column) -> Column:
    """up, flat or down by a relative change; unknown without one."""
    return F.when(change.isNull() | F.isnan(change), "unknown").when(change >= TREND, "up").when(change <= -TREND, "down").otherwise("flat")
