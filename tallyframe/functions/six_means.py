"""Indicators of the six-mean variant: simple and exponential means of 20, 60 and 120 bars, and its candidate gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ewm import span, with_ewm
from .indicators import GATES, true_range
from .windows import change, flag, rolling, run_length, sdiv, series, true

# The periods, how much wider than the strict ones the spreads' gates are, and the least dense run.
SIX_PERIODS, WIDER, DENSE_RUN = (20, 60, 120), 1.6, 5
FAST_GATE, FULL_GATE = GATES["strict"]["fast_spread"] * WIDER, GATES["strict"]["full_spread"] * WIDER


def with_six_means(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with the means and the metrics of the gates; no column looks ahead. A simple mean is NULL until its bars are there,
    and the bundle's spread is that of the means that are."""
    w = series(*keys)
    c = F.col
    means = {f"ema{p}": ("close", span(p)) for p in SIX_PERIODS} | {"atr14": ("tr", 1 / 14)}
    rows = with_ewm(bars.withColumn("tr", true_range(w)), means, keys).withColumns({f"sma{p}": rolling(F.avg, "close", p, w) for p in SIX_PERIODS})
    fast, every = [c(f"{k}{p}") for p in (20, 60) for k in ("sma", "ema")], [c(f"{k}{p}") for p in SIX_PERIODS for k in ("sma", "ema")]
    rows = rows.withColumns(
        {
            "atr_pct": sdiv("atr14", "close"), "cluster_max": F.greatest(*fast), "cluster_min": F.least(*fast), "full_spread": sdiv(F.greatest(*every) - F.least(*every), "close"),
            "volume_ratio": F.coalesce(sdiv("volume", rolling(F.avg, "volume", 20, w, 5)), F.lit(0.0)), "slow_slope_12": change("ema120", 12, w), "zero_volume96": rolling(F.avg, flag(c("volume") <= 0).cast("double"), 96, w),
            "pre_range48": sdiv(rolling(F.max, "high", 48, w) - rolling(F.min, "low", 48, w), "close"), "pre_range168": sdiv(rolling(F.max, "high", 168, w) - rolling(F.min, "low", 168, w), "close"),
            "drawdown24": sdiv(rolling(F.max, "high", 24, w), "close") - 1,
        }
    )
    pairs = [(f"{k}{a}", f"{k}{b}") for a, b in ((20, 60), (60, 120)) for k in ("sma", "ema")]
    score = lambda up: sum((flag(c(a) >= c(b) if up else c(a) <= c(b)) for a, b in pairs), F.lit(0))
    rows = rows.withColumns(
        {
            "fast_spread": sdiv(c("cluster_max") - c("cluster_min"), "close"), "fast_slow_gap": sdiv(F.abs((c("cluster_max") + c("cluster_min")) / 2 - (c("sma120") + c("ema120")) / 2), "close"),
            "full_ratio_min48": sdiv("full_spread", rolling(F.min, "full_spread", 48, w, 24)), "ext_up": sdiv("close", "cluster_max") - 1, "slow_slope_abs": F.abs("slow_slope_12"),
            "order_score": score(True), "down_order_score": score(False),
        }
    )
    room = lambda most, x, times: F.greatest(most - c(x), F.lit(0.0)) * times
    shape = room(F.lit(FAST_GATE), "fast_spread", 9000) + room(F.lit(FULL_GATE), "full_spread", 6500) + room(F.lit(1.45), "full_ratio_min48", 8) + F.least("volume_ratio", F.lit(4.0))
    dense = (c("fast_spread") <= FAST_GATE) & (c("full_spread") <= FULL_GATE)
    return rows.withColumns(
        {"trend_order_score": F.greatest("order_score", "down_order_score"), "dense_run": run_length(dense, w), "shape_score": F.when(c("full_ratio_min48").isNotNull() & c("fast_spread").isNotNull(), shape)}
    )


def six_mean_mask() -> Column:
    """The gates at once; a missing value fails."""
    g, c = GATES["expanded"], F.col
    most = [c(x) <= g[x] for x in ("full_ratio_min48", "pre_range48", "pre_range168", "slow_slope_abs", "zero_volume96")]
    mask = (c("dense_run") >= DENSE_RUN) & (c("drawdown24") <= g["pullback24"]) & c("ext_up").between(*g["ext"]) & (c("order_score") >= g["order"]) & (c("volume_ratio") >= g["volume_ratio"])
    for m in most:
        mask = mask & m
    return true(mask)
