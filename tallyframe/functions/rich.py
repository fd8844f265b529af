"""The rich feature pack: further means, spreads, momentum, volatility, candle, volume and structure columns.

Everything builds on ``with_features``; no column looks ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .ewm import span, with_ewm
from .indicators import DENSE
from .scalars import clock
from .windows import change, filled, flag, lag, position, rolling, run_length, sdiv, series, true

# Periods of the further means, lags of the slopes, changes and extremes.
PERIODS = (5, 10, 20, 60, 120)
SLOPES = {"ema8_slope8": ("ema8", 8), "ema21_slope12": ("ema21", 12), "ema55_slope24": ("ema55", 24), "ema200_slope24": ("ema200", 24), "sma60_slope12": ("sma60", 12)}
GAPS = {"gap_ema8_21": ("ema8", "ema21"), "gap_ema21_55": ("ema21", "ema55"), "gap_ema55_200": ("ema55", "ema200"), "gap_sma20_60": ("sma20", "sma60"), "gap_sma60_120": ("sma60", "sma120")}
CROSSES = {"cross_ema8_21": ("ema8", "ema21"), "cross_ema21_55": ("ema21", "ema55"), "cross_ema55_200": ("ema55", "ema200")}
RETURNS, RATES, EXTREMES = (2, 8, 16, 64, 96), (12, 48), (24, 48, 96)
#: Bars of half a swing window, and of a breakout whose volume is remembered for so many bars.
SWING, BREAKOUT, REMEMBERED = 24, 24, 3

RICH = (
    *(f"close_vs_{kind}{p}" for kind in ("sma", "ema") for p in PERIODS), *GAPS, *SLOPES, *CROSSES, "ma_entangle", "ma_bandwidth", "bb_width20",
    "fast_spread_chg4", "fast_spread_chg16", "full_spread_chg8", "full_spread_chg24", "fast_spread_rank96", "full_spread_rank96", "spread_expand_run", "spread_contract_run", "dense_run_len_fast", "exit_dense_expand",
    *(f"ret_{n}" for n in RETURNS), *(f"roc_{n}" for n in RATES), *(f"{c}_{n}" for n in EXTREMES for c in ("dist_high", "dist_low", "break_up", "break_dn", "range_pos")),
    "atr7_pct", "atr28_pct", "atr_ratio_7_28", "rvol_24", "rvol_96", "rvol_ratio_24_96", "body_ratio", "wick_up_ratio", "wick_dn_ratio", "body_ratio_mean8", "atr_chg24",
    "vol_ratio_20", "vol_ratio_96", "vol_z_24", "pv_corr_24", "breakout_vol_ratio", "up_vol_share_24",
    "struct_hh", "struct_hl", "struct_lh", "struct_ll", "struct_bias", "dist_prior_high_96", "dist_prior_low_96", "hour_sin", "hour_cos", "dow", "dow_sin", "dow_cos",
)


def _means(w: WindowSpec) -> dict[str, Column]:
    """What later columns build on."""
    out = {f"sma{p}": rolling(F.avg, "close", p, w, max(3, p // 2)) for p in PERIODS}
    out |= {f"_{c}{n}": rolling(f, x, n, w, n // 2) for n in EXTREMES for c, f, x in (("hh", F.max, "high"), ("ll", F.min, "low"))}
    out |= {"_ret1": change("close", 1, w), "_dvol": change("volume", 1, w), "_body": sdiv(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low"))}
    out |= {"_hh_half": rolling(F.max, "high", SWING, w), "_ll_half": rolling(F.min, "low", SWING, w), "_vol20": rolling(F.avg, "volume", 20, w, 5), "_vol96": rolling(F.avg, "volume", 96, w, 20)}
    return out


def _swing(w: WindowSpec) -> dict[str, Column]:
    """1 where the last half window reaches higher than the half before, -1 lower, for highs and lows; 0 without both."""
    tag = lambda c: F.coalesce(F.signum(F.col(c) - lag(c, SWING, w)), F.lit(0.0))
    return {"_high_tag": tag("_hh_half"), "_low_tag": tag("_ll_half")}


def _columns(w: WindowSpec) -> dict[str, Column]:
    c = F.col
    bar = c("high") - c("low")
    fast, full = c("fast_spread"), c("full_spread")
    out = {f"close_vs_{kind}{p}": sdiv("close", f"{kind}{p}") - 1 for kind in ("sma", "ema") for p in PERIODS}
    out |= {n: sdiv(c(a) - c(b), "close") for n, (a, b) in GAPS.items()}
    out |= {n: change(x, k, w) for n, (x, k) in SLOPES.items()}
    out |= {n: flag(c(a) > c(b)).cast("double") for n, (a, b) in CROSSES.items()}
    out |= {
        "ma_entangle": 1 / (1 + F.greatest(fast, F.lit(0.0)) * 200),
        "ma_bandwidth": sdiv(c("cluster_max") - c("cluster_min"), (c("cluster_max") + c("cluster_min")) / 2),
        "bb_width20": sdiv(2 * rolling(F.stddev_samp, "close", 20, w, 10), "sma20"),
        "fast_spread_chg4": fast - lag(fast, 4, w), "fast_spread_chg16": fast - lag(fast, 16, w), "full_spread_chg8": full - lag(full, 8, w), "full_spread_chg24": full - lag(full, 24, w),
        "fast_spread_rank96": position("fast_spread", 96, w, 48), "full_spread_rank96": position("full_spread", 96, w, 48),
        "spread_expand_run": run_length(fast > lag(fast, 1, w), w), "spread_contract_run": run_length(fast < lag(fast, 1, w), w), "dense_run_len_fast": run_length(fast <= DENSE, w),
        "exit_dense_expand": flag((lag("dense_run_len", 1, w) >= 5) & (c("spread_chg8") > 0)).cast("double"),
    }
    out |= {f"ret_{n}": change("close", n, w) for n in RETURNS} | {f"roc_{n}": change("close", n, w) for n in RATES}
    for n in EXTREMES:
        hh, ll = f"_hh{n}", f"_ll{n}"
        out |= {f"dist_high_{n}": sdiv("close", hh) - 1, f"dist_low_{n}": sdiv("close", ll) - 1, f"break_up_{n}": sdiv("close", lag(hh, 1, w)) - 1, f"break_dn_{n}": sdiv("close", lag(ll, 1, w)) - 1}
        out[f"range_pos_{n}"] = sdiv(c("close") - c(ll), c(hh) - c(ll))
    out |= {
        "atr7_pct": sdiv("atr7", "close"), "atr28_pct": sdiv("atr28", "close"), "atr_ratio_7_28": sdiv("atr7", "atr28"),
        "rvol_24": rolling(F.stddev_samp, "_ret1", 24, w, 12), "rvol_96": rolling(F.stddev_samp, "_ret1", 96, w, 48),
        "rvol_ratio_24_96": sdiv(rolling(F.stddev_samp, "_ret1", 24, w, 12), rolling(F.stddev_samp, "_ret1", 96, w, 48)),
        "body_ratio": c("_body"), "wick_up_ratio": sdiv(F.greatest(c("high") - F.greatest("open", "close"), F.lit(0.0)), bar), "wick_dn_ratio": sdiv(F.greatest(F.least("open", "close") - c("low"), F.lit(0.0)), bar),
        "body_ratio_mean8": rolling(F.avg, "_body", 8, w, 4), "atr_chg24": c("atr_pct") - lag("atr_pct", 24, w),
        "vol_ratio_20": sdiv("volume", "_vol20"), "vol_ratio_96": sdiv("volume", "_vol96"),
        "vol_z_24": sdiv(c("volume") - rolling(F.avg, "volume", 24, w, 10), rolling(F.stddev_samp, "volume", 24, w, 10)),
        "pv_corr_24": _pair_corr("_ret1", "_dvol", 24, w, 12),
        "breakout_vol_ratio": F.coalesce(filled("_loud", REMEMBERED, w), sdiv("volume", "_vol20")),
        "up_vol_share_24": sdiv(rolling(F.sum, c("volume") * flag(c("close") > c("open")), 24, w, 12), rolling(F.sum, "volume", 24, w, 12)),
        "struct_hh": flag(c("_high_tag") > 0).cast("double"), "struct_hl": flag(c("_low_tag") > 0).cast("double"), "struct_lh": flag(c("_high_tag") < 0).cast("double"), "struct_ll": flag(c("_low_tag") < 0).cast("double"),
        "struct_bias": c("_high_tag") + c("_low_tag"),
        "dist_prior_high_96": sdiv("close", rolling(F.max, "high", 96, w, 48, shift=1)) - 1, "dist_prior_low_96": sdiv("close", rolling(F.min, "low", 96, w, 48, shift=1)) - 1,
    }
    turns = clock(c("open_time"))
    return out | {"hour_sin": turns["hour_sin"], "hour_cos": turns["hour_cos"], "dow": F.weekday("open_time").cast("double"), "dow_sin": turns["day_sin"], "dow_cos": turns["day_cos"]}


def _pair_corr(x: str, y: str, n: int, w: WindowSpec, least: int) -> Column:
    """Correlation over the pairs of a window of which both values are there; NULL below ``least`` pairs or without spread."""
    frame = w.rowsBetween(-(n - 1), 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(a).over(frame) >= least, sdiv(F.covar_samp(a, b).over(frame), F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)))


def with_rich(featured: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of ``with_features`` with the columns of ``RICH``."""
    w = series(*keys)
    means = {f"ema{p}": ("close", span(p)) for p in PERIODS} | {"atr7": ("tr", 1 / 7), "atr28": ("tr", 1 / 28)}
    rows = with_ewm(featured, means, keys).withColumns(_means(w)).withColumns(_swing(w))
    loud = true(F.col("close") >= lag(f"_hh{BREAKOUT}", 1, w))
    rows = rows.withColumn("_loud", F.when(loud, sdiv("volume", "_vol20")))
    out = rows.withColumns(_columns(w))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def breakdown_quality(featured: DataFrame, averages: list[str], side: str = "short", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """How good a break below (or, on the long side, above) the bundle of ``averages`` is, in ATRs: depth beyond it, force of
    the bar's body, its range, volume against its mean, the bundle's roll over 12 bars, the share of 20 bars that step the
    same way, the way from the 20-bar extreme, the room to the 48-bar one, and the fall from the 20-bar extreme."""
    w = series(*keys)
    sign = -1.0 if side == "long" else 1.0
    c = F.col
    bundle = [c(a) for a in averages]
    short = side == "short"
    edge = F.least(*bundle) if short else F.greatest(*bundle)
    some = lambda f, x, n: f(x).over(w.rowsBetween(-(n - 1), 0))
    near, far = ("high", "low") if short else ("low", "high")
    top, bottom = (F.max, F.min) if short else (F.min, F.max)
    step = c(near) < lag(near, 1, w) if short else c(near) > lag(near, 1, w)
    atr = F.nullif("atr14", F.lit(0.0))
    rows = featured.withColumn("_center", sum(bundle[1:], bundle[0]) / len(bundle)).withColumn("_step", F.when(lag(near, 1, w).isNotNull(), flag(step)))
    extreme = some(top, near, 20)
    return rows.withColumns(
        {
            "bd_depth": sign * (edge - c("close")) / atr,
            "bd_force": sign * (c("open") - c("close")) / atr,
            "bd_range": (c("high") - c("low")) / atr,
            "vol_break": F.coalesce(sdiv("volume", some(F.avg, "volume", 20)), F.lit(1.0)),
            "ma_roll": sign * F.coalesce(sdiv(c("_center") - F.coalesce(lag("_center", 12, w), c("_center")), 12 * c("close")), F.lit(0.0)),
            "steps20": F.coalesce(F.avg("_step").over(w.rowsBetween(-18, 0)), F.lit(0.0)),
            "from_extreme20": sign * (extreme - c("close")) / atr,
            "room48": sign * (c("close") - some(bottom, far, 48)) / atr,
            "fall20": sign * (sdiv("close", extreme) - 1),
        }
    ).drop("_center", "_step")
