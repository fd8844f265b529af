"""Signals from dense stretches: tips, launches after a tip, direction rules, and breakouts of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import change, lag, rolling, run_length, sdiv, series, true
from .selection import min_gap
from .barriers import triple_barrier

#: Bars of a dense run that make a tip, and bars after it within which a launch counts.
TIP, WAIT = 5, 48
#: Bars of the range that a breakout leaves, and how much more than their mean its volume is.
RANGE, VOLUME = 20, 1.5
# Growth of the fast spread over 8 bars that counts as expanding; bars from one launch of a kind to the next.
EXPANSION, LAUNCH_GAP = 0.00383, 18


def with_tips(bars: DataFrame, dense: Column, least: int = TIP, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``bars`` with ``tip``: the bar at which a dense run reaches ``least`` bars."""
    return bars.withColumn("tip", run_length(dense, series(*keys)) == least)


def _break(high: str = "high", low: str = "low", n: int = RANGE, w=None) -> Column:
    """1 above the range of the n bars before, -1 below, 0 inside; NULL without n bars."""
    top, bottom = rolling(F.max, high, n, w, shift=1), rolling(F.min, low, n, w, shift=1)
    return F.when(F.col("close") > top, 1).when(F.col("close") < bottom, -1).when(top.isNotNull(), 0)


def launches(enriched: DataFrame, warmup: int = 0, wait: int = WAIT, gap: int = LAUNCH_GAP, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, kind, arm_i, bar_i, direction): of each tip, which arms until ``wait`` bars have passed or the next tip
    comes, the first later bar of each kind: ``range`` (the close leaves the range of the bars before), ``volume`` (so
    with much volume), ``spread`` (the fast spread expands) and ``average`` (the means or the close cross). Of each kind,
    launches less than ``gap`` bars after the last one kept are left out.

    Columns: those of ``with_indicators`` and ``tip``. No bar after a launch is read.
    """
    w = series(*keys)
    side = lambda up, down: F.when(true(up), 1).when(true(down), -1)
    rows = enriched.withColumns({"_break": _break(w=w), "_mean": rolling(F.avg, "close", 20, w), "_volume": rolling(F.avg, "volume", RANGE, w, shift=1), "_arm": F.last(F.when(F.col("tip") & (F.col("bar_i") >= warmup), F.col("bar_i")), ignorenulls=True).over(w)})
    middle = (F.col("cluster_max") + F.col("cluster_min")) / 2
    before = lambda c: lag(c, 1, w)
    cross = lambda a, b: side((before(a) <= before(b)) & (F.col(a) > F.col(b)), (before(a) >= before(b)) & (F.col(a) < F.col(b)))
    loud = true((F.col("_volume") > 0) & (F.col("volume") > F.col("_volume") * VOLUME))
    out = rows.withColumns(
        {
            "_range": F.nullif("_break", F.lit(0)),
            "_loud": F.when(loud, F.nullif("_break", F.lit(0))),
            "_spread": F.when(true(F.col("fast_spread") - lag("fast_spread", 8, w) >= EXPANSION) & (middle > 0), F.when(F.col("close") >= middle, 1).otherwise(-1)),
            "_average": F.coalesce(cross("ema8", "ema21"), F.when(before("_mean").isNotNull(), cross("close", "_mean"))),
        }
    )
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(c).alias("direction")) for n, c in (("range", "_range"), ("volume", "_loud"), ("spread", "_spread"), ("average", "_average"))))
    hits = out.where((F.col("bar_i") > F.col("_arm")) & (F.col("bar_i") <= F.col("_arm") + wait)).select(*keys, F.col("_arm").alias("arm_i"), "bar_i", F.explode(kinds).alias("k")).select(*keys, "arm_i", "bar_i", "k.*")
    fired = hits.where("direction is not null").groupBy(*keys, "kind", "arm_i").agg(F.min("bar_i").alias("bar_i"), F.min_by("direction", "bar_i").alias("direction"))
    return min_gap(fired, gap, (*keys, "kind"))


def all_average_rule(averages: list[str]) -> Column:
    """1 if the close is above all averages, -1 below all, else NULL."""
    cols = [F.col(a) for a in averages]
    return F.when(F.col("close") > F.greatest(*cols), 1).when(F.col("close") < F.least(*cols), -1)


def direction_rules(keys: tuple[str, ...] = ("symbol",)) -> dict[str, Column]:
    """Name -> 1 or -1 (or NULL) for each bar: above a slow mean, its slope, momentum, and mean and momentum agreeing.
    Columns: close, ema55, ema120 and ema200."""
    w = series(*keys)
    sign = lambda c: F.when(true(c), 1).otherwise(-1)
    momentum = lambda n: F.coalesce(change("close", n, w), F.lit(0.0))
    above = F.col("close") > F.col("ema200")
    return {
        "ema200": sign(above), "ema120": sign(F.col("close") > F.col("ema120")), "slope55": sign(F.col("ema55") - lag("ema55", 12, w) > 0), "mom24": sign(momentum(24) > 0), "mom48": sign(momentum(48) > 0),
        "combo": F.when(above & (momentum(24) > 0), 1).when((F.col("close") < F.col("ema200")) & (momentum(24) < 0), -1),
        "long": F.lit(1), "short": F.lit(-1),
    }


def straddle(trigger: int = 12, buffer: float = 0.1, target: float = 3.0, stop: float = 1.0, fade: bool = False) -> Column:
    """A stop order on either side of a range (columns range_high and range_low), over a path.

    The first of ``trigger`` bars to touch one opens a trade at that price, or against it with ``fade``; touching both in
    one bar, or none, gives ``ambiguous`` or ``no_breakout`` without a return. Target and stop count from the bar of the
    trade, the target first where both are touched; else the last close counts.
    """
    atr = F.col("atr14")
    buy, sell = F.col("range_high") + buffer * atr, F.col("range_low") - buffer * atr
    hit = F.get(F.filter("path", lambda b: (b["j"] < trigger) & ((b["high"] >= buy) | (b["low"] <= sell))), F.lit(0))
    both = (hit["high"] >= buy) & (hit["low"] <= sell)
    up = (hit["high"] >= buy) != F.lit(fade)
    entry = F.when(hit["high"] >= buy, buy).otherwise(sell)
    sign = F.when(up, 1.0).otherwise(-1.0)
    rest = F.filter("path", lambda b: b["j"] >= hit["j"])
    goal, guard = entry + sign * target * atr, entry - sign * stop * atr
    won = F.get(F.filter(rest, lambda b: F.when(up, b["high"] >= goal).otherwise(b["low"] <= goal)), F.lit(0))["j"]
    lost = F.get(F.filter(rest, lambda b: F.when(up, b["low"] <= guard).otherwise(b["high"] >= guard)), F.lit(0))["j"]
    last = F.element_at("path", -1)["close"]
    ret = F.when(won.isNotNull() & (lost.isNull() | (won <= lost)), target * atr / entry).when(lost.isNotNull(), -stop * atr / entry).otherwise(F.when(up, last / entry - 1).otherwise(entry / last - 1))
    state = F.when(hit.isNull(), "no_breakout").when(both, "ambiguous").otherwise("traded")
    return F.struct(state.alias("state"), F.when(state == "traded", sign.cast("int")).alias("direction"), F.when(state == "traded", ret).alias("gross"))


def oracle_direction(target: float = 3.0, stop: float = 1.0) -> Column:
    """The better of both sides, with ties for the target: what no rule can beat."""
    long, short = triple_barrier(target, stop, "long", "tp"), triple_barrier(target, stop, "short", "tp")
    return F.struct(long["realized_ret"].alias("long"), short["realized_ret"].alias("short"), F.greatest(long["realized_ret"], short["realized_ret"]).alias("oracle"))


def top_fraction(rows: DataFrame, score: str, part: float, keys: tuple[str, ...]) -> DataFrame:
    """The best ``part`` of each group by score, rounded up, one at least."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.desc_nulls_last(score), "bar_i"))
    return rows.withColumn("_p", place).withColumn("_n", F.count("*").over(w)).where(F.col("_p") <= F.greatest(F.ceil(F.col("_n") * part), F.lit(1))).drop("_p", "_n")


def window_schedule(bars: DataFrame, length: int = 200, stride: int = 50, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, start_i, end_i) of windows over each series, the last one at its end; none for shorter series."""
    sizes = bars.groupBy(*keys).agg((F.max("bar_i") + 1).alias("n")).where(F.col("n") >= length)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col("n") - length, F.lit(stride).cast("long")), F.array(F.col("n") - length)))
    return sizes.select(*keys, F.explode(starts).alias("start_i")).withColumn("end_i", F.col("start_i") + length - 1)


def balanced(rows: DataFrame, kind: str, most: int, background: object, share: float, *identity: str) -> DataFrame:
    """At most ``most`` rows of each kind, and ``share`` of those kept of the background kind at most, by hash order."""
    order = F.xxhash64(*identity)
    kept = rows.withColumn("_p", F.row_number().over(Window.partitionBy(kind).orderBy(order, *identity))).where(F.col("_p") <= most)
    others = F.count_if(F.col(kind) != F.lit(background)).over(Window.partitionBy(F.lit(0)))
    return kept.withColumn("_o", others).where((F.col(kind) != F.lit(background)) | (F.col("_p") <= F.ceil(F.col("_o") * share / (1 - share)))).drop("_p", "_o")


def side_form(trades: DataFrame, days: int = 7, least: int = 20) -> DataFrame:
    """``trades`` with ``form``: the mean return of the trades of the same side that closed in the ``days`` before the
    entry, NULL below ``least`` of them; from running sums and two as-of joins."""
    from .joins import range_sums

    closed = trades.select("side", (F.unix_micros(F.col("exit_time").cast("timestamp"))).alias("_t"), F.col("realized_ret").cast("double").alias("_r"), F.lit(1.0).alias("_c"))
    entry = F.unix_micros(F.col("entry_time").cast("timestamp"))
    asked = trades.withColumn("_to", entry - 1).withColumn("_from", entry - 1 - F.lit(days * 86_400_000_000))
    met = range_sums(asked, closed, ["side"], "_from", "_to", "_t", {"_r": "_sum", "_c": "_n"}, coverage=False)
    return met.withColumn("form", F.when(F.col("_n") >= least, sdiv("_sum", "_n"))).drop("_to", "_from", "_sum", "_n")


def gap_guarded(fresh: DataFrame, log: DataFrame, seconds: int, time: str = "signal_time", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Signals of a pulse that may enter the log: those it has already, and of the others, from early to late, those at least
    so many seconds from every signal of their key in the log and after the last one let in."""
    from .joins import nearest_seconds

    known = log.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    held = fresh.join(known, [*keys, time], "left_semi")
    new = nearest_seconds(fresh.join(known, [*keys, time], "left_anti"), known, list(keys), time).where((F.col("nearest_s") >= seconds) | F.col("nearest_s").isNull()).drop("nearest_s")
    placed = new.withColumn("bar_i", F.unix_seconds(F.col(time).cast("timestamp")))
    return held.unionByName(min_gap(placed, seconds, keys).drop("bar_i"))


def actionable(log: DataFrame, statuses: tuple[str, ...], least_score: float, minutes: float, now: Column, time: str = "signal_time") -> DataFrame:
    """Signals with one of the statuses and a score, not older than so many minutes, in order of time."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))) / 60
    return log.where(F.col("status").isin(*statuses) & (F.col("score") >= least_score) & (age <= minutes)).orderBy(time)


def timed_out(positions: DataFrame, hours: float, now: Column, time: str = "entry_time") -> Column:
    """Whether a position has been held for so long that it must close; one of unknown age never must."""
    return F.coalesce((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))) / 3600 >= hours, F.lit(False))


def control_sample(eligible: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """As many eligible bars of each series as were chosen there, by the hash of series and bar: a control that every run draws
    alike."""
    counts = chosen.groupBy(*keys).agg(F.count("*").alias("_many"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", *keys, F.col("bar_i").cast("string"))), "bar_i"))
    return eligible.withColumn("_place", place).join(counts, list(keys)).where(F.col("_place") <= F.col("_many")).drop("_place", "_many")
