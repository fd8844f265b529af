"""The broad bank: return lags, rolling families over many windows, mean pairs and candle shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ewm import span, with_ewm
from .windows import change, lag, rolling, rolling_skew, sdiv, series

# Lags, windows, pairs of means and windows of tightness.
LAGS = (1, 2, 3, 5, 8, 12, 24, 48, 96)
WINDOWS = (3, 5, 10, 20, 30, 60, 120)
PAIRS = ((5, 20), (10, 30), (20, 60), (10, 60), (20, 120))
TIGHT = (5, 8, 12)


def _family(k: int, w) -> dict[str, Column]:
    high, low = rolling(F.max, "high", k, w), rolling(F.min, "low", k, w)
    volume = rolling(F.avg, "volume", k, w)
    return {
        f"vol_{k}": rolling(F.stddev_samp, "_ret", k, w),
        f"skew_{k}": rolling_skew("_ret", k, w),
        f"maxret_{k}": rolling(F.max, "_ret", k, w),
        f"minret_{k}": rolling(F.min, "_ret", k, w),
        f"pos_{k}": sdiv(F.col("close") - low, high - low),
        f"cma_{k}": sdiv("close", rolling(F.avg, "close", k, w)) - 1,
        f"cema_{k}": sdiv("close", f"_ema{k}") - 1,
        f"volr_{k}": sdiv("volume", volume),
        f"volstd_{k}": sdiv(rolling(F.stddev_samp, "volume", k, w), volume),
        f"rng_{k}": sdiv(rolling(F.avg, "_range", k, w), "close"),
        f"rngz_{k}": sdiv(F.col("_range") - rolling(F.avg, "_range", k, w), rolling(F.stddev_samp, "_range", k, w)),
        f"slope_{k}": sdiv(F.col("close") - lag("close", k, w), F.lit(float(k)) * F.col("close")),
    }


def names() -> list[str]:
    bank = [f"{f}_{k}" for k in WINDOWS for f in ("vol", "skew", "maxret", "minret", "pos", "cma", "cema", "volr", "volstd", "rng", "rngz", "slope")]
    return [*(f"ret_{k}" for k in LAGS), *bank, *(f"spread_{a}_{b}" for a, b in PAIRS), "body_frac", "upwick", "dnwick", "updown", *(f"close_tight_{k}" for k in TIGHT)]


def with_broad(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``bars`` with the 105 columns of ``names``; all windows share one sort of each series."""
    w = series(*keys)
    spans = sorted({*WINDOWS, *(n for pair in PAIRS for n in pair)})
    base = with_ewm(bars, {f"_ema{n}": ("close", span(n)) for n in spans}, keys)
    base = base.withColumns({"_ret": change("close", 1, w), "_range": F.nullif(F.col("high") - F.col("low"), F.lit(0.0))})
    new = {f"ret_{k}": change("close", k, w) for k in LAGS}
    for k in WINDOWS:
        new |= _family(k, w)
    new |= {f"spread_{a}_{b}": sdiv(F.abs(F.col(f"_ema{a}") - F.col(f"_ema{b}")), "close") for a, b in PAIRS}
    new |= {
        "body_frac": F.abs(F.col("close") - F.col("open")) / F.col("_range"),
        "upwick": (F.col("high") - F.greatest("open", "close")) / F.col("_range"),
        "dnwick": (F.least("open", "close") - F.col("low")) / F.col("_range"),
        "updown": F.signum(F.col("close") - F.col("open")),
        **{f"close_tight_{k}": sdiv(rolling(F.stddev_samp, "close", k, w), "close") for k in TIGHT},
    }
    return base.withColumns(new).drop("_ret", "_range", *(f"_ema{n}" for n in spans))
