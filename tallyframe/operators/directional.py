"""Trades whose selection depends on what their paths allow, and what either direction would have made of them.

Rows carry ``path``, the bars after the signal as far as there are any (``outcomes.with_open_path``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import run_length, series
from .outcomes import LEAST_PATH
from .selection import min_gap

#: Bars of the range before a signal, bars in which its break must come, and the least bars after a break.
RANGE_BARS, BREAK_BARS, LEAST_BROKEN = 20, 6, 4


def dense_tips(bars: DataFrame, dense: Column, least: int = 5, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bars at which a dense run reaches exactly ``least`` bars, with the high and low of the ``RANGE_BARS`` bars up to them."""
    w = series(*keys)
    seen = w.rowsBetween(-(RANGE_BARS - 1), 0)
    rows = bars.withColumn("_run", run_length(dense, w)).withColumn("range_high", F.max("high").over(seen)).withColumn("range_low", F.min("low").over(seen))
    return rows.where(F.col("_run") == least).drop("_run")


def takeable(horizon: int) -> Column:
    """Whether a trade can be entered at all and has bars enough to judge it; signals without an ATR or price that allow it
    have no row in ``with_open_path``."""
    return ~F.col("pending") & (F.size(F.filter("path", lambda b: b["j"] < horizon)) >= LEAST_PATH)


def taken_apart(paths: DataFrame, gap: int, horizon: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Of signals with paths those taken: from left to right each that is ``gap`` bars or more after the last one taken. A
    signal that can't be taken doesn't count as the last one, so its outcome decides on those after it."""
    return min_gap(paths.where(takeable(horizon)), gap, keys)


def first_touch(path: Column, entry: Column, sign: int | Column, target: float, stop: float) -> Column:
    """The return of a trade in one direction: the target's where it is touched first or with the stop, the stop's, or that of
    the last close. Targets and stops are multiples of the ATR at the signal."""
    atr, long = F.col("atr14"), F.lit(sign) > 0
    goal, guard = entry + F.lit(sign) * target * atr, entry - F.lit(sign) * stop * atr
    at = lambda test: F.get(F.filter(path, test), F.lit(0))["j"]
    won = at(lambda b: F.when(long, b["high"] >= goal).otherwise(b["low"] <= goal))
    lost = at(lambda b: F.when(long, b["low"] <= guard).otherwise(b["high"] >= guard))
    last = F.element_at(path, -1)["close"]
    return F.when(won.isNotNull() & (lost.isNull() | (won <= lost)), target * atr / entry).when(lost.isNotNull(), -stop * atr / entry).otherwise(F.when(long, last / entry - 1).otherwise(entry / last - 1))


def direction_outcomes(horizon: int, target: float = 3.0, stop: float = 1.0, cost: float = 0.0) -> Column:
    """(long, short, breakout, oracle) of a path of ``horizon + BREAK_BARS`` bars: either side from the first bar's open; the side
    on which one of the next ``BREAK_BARS`` closes leaves the range before the signal, from the open of the bar after it,
    NULL without such a close or with fewer than ``LEAST_BROKEN`` bars after it; and the better side, which no rule beats."""
    own = F.filter("path", lambda b: b["j"] < horizon)
    net = lambda path, entry, sign: first_touch(path, entry, sign, target, stop) - cost
    long, short = net(own, F.col("entry_price"), 1), net(own, F.col("entry_price"), -1)
    broken = F.get(F.filter("path", lambda b: (b["j"] < BREAK_BARS) & ((b["close"] > F.col("range_high")) | (b["close"] < F.col("range_low")))), F.lit(0))
    sign = F.when(broken["close"] > F.col("range_high"), 1).otherwise(-1)
    rest = F.filter("path", lambda b: (b["j"] > broken["j"]) & (b["j"] <= broken["j"] + horizon))
    entry = F.get(rest, F.lit(0))["open"]
    breakout = F.when(broken.isNotNull() & (F.size(rest) >= LEAST_BROKEN) & (entry > 0), net(rest, entry, sign))
    return F.struct(long.alias("long"), short.alias("short"), breakout.alias("breakout"), F.greatest(long, short).alias("oracle"))


def by_rule(rows: DataFrame, outcomes: str = "o") -> DataFrame:
    """(rule, n, win_rate, profit_factor, mean_bps) of long, short, breakout and oracle; trades a rule hasn't don't count."""
    from .metrics import profit_factor

    each = rows.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"{outcomes}.{r}").alias("net")) for r in ("long", "short", "breakout", "oracle")))).alias("x")).select("x.*").where("net is not null")
    net = F.col("net")
    return each.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg((net > 0).cast("double")), 3).alias("win_rate"), F.round(profit_factor(net), 3).alias("profit_factor"), F.round(F.avg(net) * 1e4, 1).alias("mean_bps"))
