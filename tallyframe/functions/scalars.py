"""Scalar functions of symbols, times, prices, scores and votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each timeframe's weight in a composite, and the least composites of the grades.
WEIGHTS = {"1m": 0.10, "3m": 0.12, "5m": 0.13, "15m": 0.35, "30m": 0.30}
OTHER_WEIGHT, GRADES = 0.1, {"A": 0.68, "B": 0.52}
# From which multiple of its threshold, or which score where there is none, a score has how many stars.
STARS, STARS_ALONE = (1.0, 1.10, 1.25, 1.50, 2.00), (0.015, 0.022, 0.028, 0.035, 0.050)
# Costs of a round trip, as parts of its notional.
COSTS = {"spot_taker": 0.003, "spot_maker": 0.0016, "swap_maker": 0.0006, "swap_taker": 0.0010, "legacy": 0.002}
COST_SWEEP = (0.002, 0.003, 0.004)


def instrument(symbol: Column) -> Column:
    """``BTC_USDT_SWAP`` as ``BTC-USDT-SWAP``."""
    return F.replace(symbol, F.lit("_"), F.lit("-"))


def display_name(symbol: Column) -> Column:
    """The base of a symbol."""
    return F.regexp_replace(symbol, r"[_-]USDT([_-]SWAP)?$", "")


def is_swap(symbol: Column) -> Column:
    return F.coalesce(F.endswith(symbol, F.lit("_USDT_SWAP")), F.lit(False))


def eval_split(symbol: Column, modulus: int = 7) -> Column:
    """The SHA-1 of a symbol modulo a small number, digit by digit, as a whole it is too large for a number."""
    return F.aggregate(F.split(F.sha1(symbol), ""), F.lit(0), lambda acc, d: F.when(d == "", acc).otherwise((acc * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % modulus))


def display_time(ts: Column) -> Column:
    """UTC as local time eight hours ahead, to the minute."""
    return F.date_format(ts + F.expr("interval 8 hours"), "yyyy-MM-dd HH:mm")


def clock(ts: Column) -> dict[str, Column]:
    """The hour and the weekday (Monday first) as points on circles."""
    turn = lambda x, n: F.lit(6.283185307179586) * x / n
    return {"hour_sin": F.sin(turn(F.hour(ts), 24)), "hour_cos": F.cos(turn(F.hour(ts), 24)), "day_sin": F.sin(turn(F.weekday(ts), 7)), "day_cos": F.cos(turn(F.weekday(ts), 7))}


def lots(size: Column, lot: Column, least: Column) -> Column:
    """A size rounded down to lots, at least the least size; a lot that isn't positive counts as 1."""
    lot = F.when(lot > 0, lot).otherwise(1.0)
    return F.greatest(F.floor(size / lot + 1e-12) * lot, least)


def ticks(price: Column, tick: Column) -> Column:
    """A price rounded to ticks, halves to the even one."""
    return F.bround(price / F.nullif(tick, F.lit(0.0)), 0) * tick


def barrier_prices(entry: Column, atr: Column, side: Column, target: float = 5.0, stop: float = 2.0) -> Column:
    """Target and stop prices; NULL without a positive entry and ATR."""
    sign = F.when(side == "short", -1.0).otherwise(1.0)
    return F.when((entry > 0) & (atr > 0), F.struct((entry + sign * target * atr).alias("target"), (entry - sign * stop * atr).alias("stop")))


def stars(score: Column, threshold: Column) -> Column:
    """0 to 5 by the score over its threshold, or, without a positive threshold, by the score alone; 0 for a missing or
    infinite score."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    passed = lambda x, bounds: sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    some = F.when(finite(threshold) & (threshold > 0), passed(score / threshold, STARS)).otherwise(passed(score, STARS_ALONE))
    return F.when(finite(score), some).otherwise(0)


def tier(score: Column, threshold: Column, q95: Column, q99: Column) -> Column:
    """0 below the threshold or without a score; then 1, 2 from q95, 3 from q99. An edge belongs to the upper band."""
    ok = score.isNotNull() & ~F.isnan(score)
    return F.when(ok & (score >= q99), 3).when(ok & (score >= q95), 2).when(ok & (score >= threshold), 1).otherwise(0)


def size_multiplier(x: Column) -> Column:
    """Between 0 and 2; 1 where missing."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(F.nanvl(x, F.lit(1.0)), F.lit(1.0))))


def _mean(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))


def timeframe_vote(widest: float) -> Column:
    """A timeframe's vote, 0 to 1, from a bar with ``dense``, ``order_score``, ``ma_spread_pct``, ``close``, ``ema55``, ``ext_up``
    and ``atr_pct``: the mean of six judgments. ``widest`` is the spread at which closeness counts nothing."""
    spread, atr = (F.when(~F.isnan(c), c) for c in (F.col("ma_spread_pct"), F.col("atr_pct")))
    ext = F.coalesce(F.col("ext_up"), F.lit(0.0))
    parts = [
        F.when(F.col("dense"), 1.0).otherwise(0.25),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("order_score"), F.lit(0)) / 4.0)),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread / widest)), F.lit(0.3)),
        F.when(F.col("close") >= F.col("ema55"), 0.85).when(F.col("ema55").isNotNull(), 0.25).otherwise(0.5),
        F.when(ext > 0.01, 0.2).when(ext > 0.005, 0.45).otherwise(0.8),
        F.when(atr.isNull(), 0.5).when(atr < 0.001, 0.3).when(atr > 0.04, 0.35).otherwise(0.75),
    ]
    return F.round(_mean(parts), 4)


def composite(votes: dict[str, Column], side: Column, rank: Column, weights: dict[str, float] | None = None) -> Column:
    """(base, boost, align, composite, grade) from votes by timeframe: structs of ``vote``, ``dense`` and ``above`` (whether
    the close is above its mean of 55), NULL where a timeframe is missing.

    The base is the weighted mean of the votes that are there. Leaders among the gainers are lifted and losers damped, by
    rank; agreement of 15m and 30m lifts, and short timeframes that are dense below a falling 30m damp.
    """
    weights = weights or WEIGHTS
    zero, no = F.lit(0.0), F.lit(False)
    weight = {k: weights.get(k, OTHER_WEIGHT) for k in votes}
    total = sum((F.when(v.isNotNull(), weight[k]).otherwise(zero) for k, v in votes.items()), zero)
    base = F.coalesce(sum((F.coalesce(v["vote"] * weight[k], zero) for k, v in votes.items()), zero) / F.nullif(total, zero), zero)
    boost = F.when(side == "gain", F.greatest(zero, 0.06 - 0.01 * (rank - 1))).when(side == "loss", F.greatest(F.lit(-0.04), -0.02 + 0.005 * (rank - 1))).otherwise(zero)
    is_ = lambda k, field: F.coalesce(votes[k][field], no) if k in votes else no
    short = sum((F.when(is_(k, "dense"), 1).otherwise(0) for k in ("1m", "3m", "5m")), F.lit(0))
    falling = F.coalesce(~votes["30m"]["above"], no) if "30m" in votes else no
    align = F.when(is_("15m", "above") & is_("30m", "above"), 0.04).otherwise(zero) + F.when(is_("15m", "dense") & is_("30m", "dense"), 0.03).otherwise(zero) - F.when(falling & (short >= 2), 0.05).otherwise(zero)
    whole = F.greatest(zero, F.least(F.lit(1.0), base + boost + align))
    there = votes["30m"].isNotNull() if "30m" in votes else no
    dense, rising = is_("15m", "dense") | is_("30m", "dense"), is_("15m", "above") & (is_("30m", "above") | ~there)
    return F.struct(*(F.round(c, 4).alias(n) for n, c in (("base", base), ("boost", boost), ("align", align), ("composite", whole))), grade(whole, dense, rising).alias("grade"))


def grade(score: Column, dense: Column, rising: Column) -> Column:
    """A needs a dense and rising higher timeframe, too."""
    return F.when((score >= GRADES["A"]) & dense & rising, "A").when(score >= GRADES["B"], "B").otherwise("C")
