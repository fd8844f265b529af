"""Causal indicator, feature and factor columns of bar series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .ewm import span, with_ewm
from .windows import change, finite, flag, lag, position, rolling, rolling_corr, rolling_skew, run_length, sdiv, series, true, ts_rank

# Spans of the means, and those that make the fast cluster.
SPANS = (8, 13, 21, 34, 55, 144, 200)
CLUSTER = (8, 13, 21, 34, 55)
#: Spread up to which a bar is dense.
DENSE = 0.0028

# Gates of the candidate masks.
GATES = {
    "strict": {
        "fast_spread": 0.0028, "full_spread": 0.0055, "fast_slow_gap": 0.0035, "full_ratio_min48": 1.45, "pre_range48": 0.032, "pre_range168": 0.075,
        "pullback24": 0.007, "ext": (-0.0015, 0.0075), "order": 3, "slow_slope_abs": 0.0009, "zero_volume96": 0.02, "volume_ratio": 0.7,
    },
    "expanded": {
        "fast_spread": 0.0045, "full_spread": 0.0088, "fast_slow_gap": 0.0056, "full_ratio_min48": 1.80, "pre_range48": 0.048, "pre_range168": 0.110,
        "pullback24": 0.012, "ext": (-0.0030, 0.0120), "order": 3, "slow_slope_abs": 0.0015, "zero_volume96": 0.02, "volume_ratio": 0.5,
    },
}

# The 28 features of the judgment model, in its input order.
FEATURES = (
    "ma_spread_pct", "full_spread", "fast_slow_gap", "full_ratio_min48", "spread_mean8", "spread_mean24", "spread_chg8", "spread_chg24", "spread_pos96",
    "dense_run_len", "dense_frac48",
    "ext_up", "close_vs_ema55", "close_vs_ema200", "order_score", "slow_slope_12",
    "volume_ratio", "volume_z", "vol_ratio_mean8",
    "atr_pct", "atr_pct_ratio96", "pre_range48", "pre_range168", "drawdown24",
    "ret_4", "ret_12", "ret_24", "ret_48",
)


def true_range(w: WindowSpec) -> Column:
    before = lag("close", 1, w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_averages(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with ema8 to ema200, the true range's mean atr14, and atr_pct: one pass over each series for all means."""
    w = series(*keys)
    means = {f"ema{n}": ("close", span(n)) for n in SPANS} | {"atr14": ("tr", 1 / 14)}
    return with_ewm(bars.withColumn("tr", true_range(w)), means, keys).withColumn("atr_pct", sdiv("atr14", "close"))


def _score(pairs: list[tuple[str, str]], up: bool) -> Column:
    return sum((flag(F.col(a) >= F.col(b) if up else F.col(a) <= F.col(b)) for a, b in pairs), F.lit(0))


def with_indicators(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with averages, volume statistics and the metrics of the masks; no column looks ahead."""
    w = series(*keys)
    fast = [F.col(f"ema{n}") for n in CLUSTER]
    slow = [F.col(f"ema{n}") for n in SPANS]
    out = with_averages(bars, keys).withColumns(
        {
            "volume_z": F.coalesce(sdiv(F.col("volume") - rolling(F.avg, "volume", 96, w, 20), rolling(F.stddev_samp, "volume", 96, w, 20)), F.lit(0.0)),
            "volume_ratio": F.coalesce(sdiv("volume", rolling(F.avg, "volume", 20, w, 5)), F.lit(0.0)),
            "cluster_max": F.greatest(*fast),
            "cluster_min": F.least(*fast),
            "full_spread": sdiv(F.greatest(*slow) - F.least(*slow), "close"),
            "pre_range48": sdiv(rolling(F.max, "high", 48, w) - rolling(F.min, "low", 48, w), "close"),
            "pre_range168": sdiv(rolling(F.max, "high", 168, w) - rolling(F.min, "low", 168, w), "close"),
            "drawdown24": sdiv(rolling(F.max, "high", 24, w), "close") - 1,
            "runup24": sdiv("close", rolling(F.min, "low", 24, w)) - 1,
            "slow_slope_12": change("ema200", 12, w),
            "zero_volume96": rolling(F.avg, flag(F.col("volume") <= 0).cast("double"), 96, w),
        }
    )
    order = [(f"ema{a}", f"ema{b}") for a, b in zip(CLUSTER, CLUSTER[1:], strict=False)]
    out = out.withColumns(
        {
            "fast_spread": sdiv(F.col("cluster_max") - F.col("cluster_min"), "close"),
            "fast_slow_gap": sdiv(F.abs((F.col("cluster_max") + F.col("cluster_min")) / 2 - (F.col("ema144") + F.col("ema200")) / 2), "close"),
            "full_ratio_min48": sdiv("full_spread", rolling(F.min, "full_spread", 48, w, 24)),
            "ext_up": sdiv("close", "cluster_max") - 1,
            "ext_down": sdiv("cluster_min", "close") - 1,
            "slow_slope_abs": F.abs("slow_slope_12"),
            "order_score": _score(order, True),
            "down_order_score": _score(order, False),
        }
    )
    room = lambda most, c, times: F.greatest(F.lit(most) - F.col(c), F.lit(0.0)) * times
    g = GATES["strict"]
    shape = room(g["fast_spread"], "fast_spread", 9000) + room(g["full_spread"], "full_spread", 6500) + room(g["fast_slow_gap"], "fast_slow_gap", 5000) + room(g["full_ratio_min48"], "full_ratio_min48", 8)
    return out.withColumn("shape_score", F.when(F.col("full_ratio_min48").isNotNull(), shape + F.least("volume_ratio", F.lit(4.0))))


def candidate_mask(mode: str = "strict", side: str = "long", gates: dict | None = None) -> Column:
    """The twelve gates at once; a missing value fails. The short side mirrors pullback, extension and order."""
    if side not in ("long", "short"):
        raise ValueError(f"{side!r} is no side; it is long or short")
    g = gates or GATES[mode]
    most = [F.col(c) <= g[c] for c in ("fast_spread", "full_spread", "fast_slow_gap", "full_ratio_min48", "pre_range48", "pre_range168", "slow_slope_abs", "zero_volume96")]
    pullback, ext, order = ("drawdown24", "ext_up", "order_score") if side == "long" else ("runup24", "ext_down", "down_order_score")
    mask = (F.col(pullback) <= g["pullback24"]) & F.col(ext).between(*g["ext"]) & (F.col(order) >= g["order"]) & (F.col("volume_ratio") >= g["volume_ratio"])
    for m in most:
        mask = mask & m
    return true(mask)


def rule_mask(clauses: list[tuple[str, str, float]]) -> Column:
    """A conjunction of (column, ``<=`` or ``>=``, threshold); a missing or infinite value fails."""
    mask = F.lit(True)
    for name, op, threshold in clauses:
        if op not in ("<=", ">="):
            raise ValueError(f"{op!r} is neither <= nor >=")
        x = finite(F.col(name).cast("double"))
        mask = mask & true(x <= threshold if op == "<=" else x >= threshold)
    return mask


def with_features(enriched: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Indicators with the model's further features."""
    w = series(*keys)
    dense = F.col("fast_spread") <= DENSE
    return enriched.withColumns(
        {
            "ma_spread_pct": F.col("fast_spread"),
            "spread_mean8": rolling(F.avg, "fast_spread", 8, w),
            "spread_mean24": rolling(F.avg, "fast_spread", 24, w),
            "spread_chg8": F.col("fast_spread") - lag("fast_spread", 8, w),
            "spread_chg24": F.col("fast_spread") - lag("fast_spread", 24, w),
            "spread_pos96": position("fast_spread", 96, w, 48),
            "dense_run_len": run_length(dense, w),
            "dense_frac48": rolling(F.avg, flag(dense).cast("double"), 48, w, 24),
            "close_vs_ema55": sdiv("close", "ema55") - 1,
            "close_vs_ema200": sdiv("close", "ema200") - 1,
            "vol_ratio_mean8": rolling(F.avg, "volume_ratio", 8, w),
            "atr_pct_ratio96": sdiv("atr_pct", rolling(F.avg, "atr_pct", 96, w, 48)),
            **{f"ret_{n}": change("close", n, w) for n in (4, 12, 24, 48)},
        }
    )


def for_side(side: str) -> dict[str, Column]:
    """The features that change with the side: on the short one, names keep their meaning for a falling price."""
    if side == "long":
        return {}
    turned = {"ext_up": F.col("ext_down"), "order_score": F.col("down_order_score"), "drawdown24": F.col("runup24"), "slow_slope_12": -F.col("slow_slope_12")}
    turned |= {f"close_vs_ema{n}": sdiv(f"ema{n}", "close") - 1 for n in (55, 200)}
    return turned | {f"ret_{n}": -F.col(f"ret_{n}") for n in (4, 12, 24, 48)}


def _obv(w: WindowSpec) -> Column:
    return F.sum(F.coalesce(F.signum(F.col("close") - lag("close", 1, w)), F.lit(0.0)) * F.col("volume")).over(w)


def _dryup(w: WindowSpec) -> Column:
    dense = flag(F.col("fast_spread") <= DENSE)
    inside = sdiv(rolling(F.sum, F.col("volume") * dense, 8, w, 1), rolling(F.sum, dense, 8, w, 1))
    return sdiv(F.coalesce(inside, rolling(F.avg, "volume", 8, w, 1)), rolling(F.avg, "volume", 48, w, 24, shift=8))


def _vwap(w: WindowSpec) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return sdiv("close", sdiv(rolling(F.sum, typical * F.col("volume"), 20, w), rolling(F.sum, "volume", 20, w))) - 1


def _bundle() -> list[Column]:
    return [F.col(f"ema{n}") for n in (*CLUSTER, 144)]


#: Name -> builder of the column from the series' window. Some build on columns of ``with_indicators`` or on the helper
#: columns of ``HELPERS``, since a window can't stand in another.
FACTORS: dict[str, Callable[[WindowSpec], Column]] = {
    "rev5": lambda w: -change("close", 5, w),
    "mom20": lambda w: change("close", 20, w),
    "hl_pos": lambda w: sdiv(F.col("close") - rolling(F.min, "low", 20, w), rolling(F.max, "high", 20, w) - rolling(F.min, "low", 20, w)),
    "vp_corr": lambda w: rolling_corr("close", "volume", 10, w),
    "illiq": lambda w: rolling(F.avg, sdiv(F.abs("_ret1"), "volume"), 20, w) * 1e6,
    "vol_share": lambda w: sdiv("volume", rolling(F.avg, "volume", 20, w)),
    "close_to_high": lambda w: sdiv(F.col("high") - F.col("close"), F.col("high") - F.col("low")),
    "updown_vol": lambda w: sdiv(rolling(F.sum, F.signum("_diff1") * F.col("volume"), 20, w), rolling(F.sum, "volume", 20, w)),
    "ret_skew": lambda w: rolling_skew("_ret1", 20, w),
    "vol_of_vol": lambda w: rolling(F.stddev_samp, "_range5", 20, w),
    "ts_rank_close": lambda w: ts_rank("close", 20, w),
    "boll_pos": lambda w: sdiv(F.col("close") - rolling(F.avg, "close", 20, w), rolling(F.stddev_samp, "close", 20, w)),
    "range_compress": lambda w: sdiv(rolling(F.max, "high", 5, w) - rolling(F.min, "low", 5, w), rolling(F.max, "high", 20, w) - rolling(F.min, "low", 20, w)),
    "vwap_dev": _vwap,
    "obv_slope": lambda w: sdiv((F.col("_obv") - lag("_obv", 20, w)) / 20, rolling(F.avg, F.abs("_obv"), 20, w, 10)),
    "vol_dryup": _dryup,
    "taker_imbalance": lambda w: sdiv(rolling(F.avg, sdiv(F.col("close") - F.col("low"), F.col("high") - F.col("low")) * F.col("volume"), 20, w, 10), rolling(F.avg, "volume", 20, w, 10)),
    "ma_order_score": lambda w: _score([(f"ema{a}", f"ema{b}") for a, b in zip((*CLUSTER, 144), (*CLUSTER, 144)[1:], strict=False)], True).cast("double"),
    "convergence_speed": lambda w: (F.col("fast_spread") - lag("fast_spread", 4, w)) - (lag("fast_spread", 4, w) - lag("fast_spread", 8, w)),
    "ma_bandwidth_pct": lambda w: sdiv(F.greatest(*_bundle()) - F.least(*_bundle()), "close"),
}
HELPERS: dict[str, Callable[[WindowSpec], Column]] = {
    "_ret1": lambda w: change("close", 1, w),
    "_diff1": lambda w: F.col("close") - lag("close", 1, w),
    "_range5": lambda w: rolling(F.avg, sdiv(F.col("high") - F.col("low"), "close"), 5, w),
    "_obv": _obv,
}


def with_factors(enriched: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Indicators with the named factors (all of them by default)."""
    unknown = set(names or ()) - set(FACTORS)
    if unknown:
        raise KeyError(f"no such factor: {', '.join(sorted(unknown))}")
    w = series(*keys)
    helped = enriched.withColumns({n: f(w) for n, f in HELPERS.items()})
    return helped.withColumns({n: FACTORS[n](w) for n in names or FACTORS}).drop(*HELPERS)
