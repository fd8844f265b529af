"""Outcomes of trades along the bars that follow a signal.

A signal is a row with the keys of its series, its ``bar_i``, ``atr14`` and ``atr_pct``. Its path are the next ``horizon``
bars, fetched by one equi-join on the series and the bar (a signal asks for each of its bars), so that a long series is
dealt out by bar. The exits are folds over the path, which is an array of at most ``horizon`` bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import finite

#: Multiples of ATR14 for target and stop, bars of a path, and the least relative ATR worth trading.
TARGET, STOP, HORIZON, LEAST_ATR = 5.0, 2.0, 72, 0.0015
OUTCOME = "struct<label: int, outcome: string, exit_offset: int, entry_price: double, realized_ret: double>"


def with_path(signals: DataFrame, bars: DataFrame, horizon: int = HORIZON, entry: str = "next_open", least_atr: float = LEAST_ATR, keys: tuple[str, ...] = ("symbol",), extra: tuple[str, ...] = ()) -> DataFrame:
    """Signals with ``entry_price`` and ``path``, an array of (j, open, high, low, close and ``extra``) by offset from 0.

    Signals without a full path, a positive price and ATR or a relative ATR of ``least_atr`` are left out.
    """
    if entry not in ("next_open", "signal_close"):
        raise ValueError(f"{entry!r} is no entry; it is next_open or signal_close")
    atr = (F.col("atr14") > 0) & ~F.isnan("atr14") & ((F.col("atr_pct") >= least_atr) if least_atr > 0 else F.lit(True))
    asked = signals.where(F.coalesce(atr, F.lit(False))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    asked = asked.withColumn("_at", F.col("bar_i") + 1 + F.col("_j"))
    prices = ("open", "high", "low", "close", *extra)
    ahead = bars.select(*keys, F.col("bar_i").alias("_at"), F.struct(*prices).alias("_bar"))
    met = asked.join(ahead, [*keys, "_at"])
    own = [c for c in signals.columns if c not in keys and c != "bar_i"]
    rows = met.groupBy(*keys, "bar_i").agg(*(F.first(c).alias(c) for c in own), F.array_sort(F.collect_list(F.struct(F.col("_j").alias("j"), *(F.col(f"_bar.{p}").alias(p) for p in prices)))).alias("path"))
    rows = rows.where(F.size("path") == horizon)
    fill = F.get("path", F.lit(0))["open"] if entry == "next_open" else F.col("close")
    return rows.withColumn("entry_price", fill).where(F.col("entry_price") > 0)


def _first(condition: Callable[[Column], Column], path: Column | None = None) -> Column:
    """Offset of the first bar for which the condition holds; NULL if none."""
    path = F.col("path") if path is None else path
    return F.get(F.filter(path, condition), F.lit(0))["j"]


def _outcome(label: Column, outcome: Column | str, offset: Column, ret: Column) -> Column:
    outcome = F.lit(outcome) if isinstance(outcome, str) else outcome
    return F.struct(label.cast("int").alias("label"), outcome.alias("outcome"), offset.cast("int").alias("exit_offset"), F.col("entry_price").alias("entry_price"), ret.cast("double").alias("realized_ret"))


def _ret(price: Column, side: str) -> Column:
    return price / F.col("entry_price") - 1 if side == "long" else F.col("entry_price") / price - 1


def _last() -> Column:
    return F.element_at("path", -1)


def triple_barrier(target: float | Column = TARGET, stop: float | Column = STOP, side: str = "long", tie: str = "sl") -> Column:
    """Target or stop, whichever is touched first; both in one bar is the stop (``tie='tp'``: the target); else the last
    close. NULL on the short side if the target isn't positive."""
    sign = 1 if side == "long" else -1
    up = F.col("entry_price") + sign * F.lit(target) * F.col("atr14")
    down = F.col("entry_price") - sign * F.lit(stop) * F.col("atr14")
    hit_up = _first(lambda b: b["high"] >= up if side == "long" else b["low"] <= up)
    hit_down = _first(lambda b: b["low"] <= down if side == "long" else b["high"] >= down)
    wins = hit_up.isNotNull() & (hit_down.isNull() | (hit_up < hit_down if tie == "sl" else hit_up <= hit_down))
    same = hit_up == hit_down
    out = (
        F.when(wins, _outcome(F.lit(1), "tp", hit_up + 1, _ret(up, side)))
        .when(hit_down.isNotNull(), _outcome(F.lit(0), F.when(F.coalesce(same, F.lit(False)), "sl_ambiguous").otherwise("sl"), hit_down + 1, _ret(down, side)))
        .otherwise(_outcome(F.lit(0), "timeout", F.size("path"), _ret(_last()["close"], side)))
    )
    return F.when(up > 0, out)


def _fold(state: Column, step: Callable[[Column, Column], Column], path: Column | None = None) -> Column:
    return F.aggregate(F.col("path") if path is None else path, state, step)


def _stopped(side: str, bar: Column, stop: Column) -> Column:
    return bar["low"] <= stop if side == "long" else bar["high"] >= stop


def _gap_fill(side: str, bar: Column, stop: Column) -> Column:
    """What a stop fills at: the open, if the bar opens beyond it."""
    return F.least(stop, bar["open"]) if side == "long" else F.greatest(stop, bar["open"])


def trailing(multiple: float = 3.0, side: str = "long") -> Column:
    """A stop that follows the running extreme of the bars before at ``multiple`` ATRs."""
    sign = 1 if side == "long" else -1
    state = F.struct(F.col("entry_price").alias("run"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("price"))

    def step(acc, bar):
        stop = acc["run"] - sign * multiple * F.col("atr14")
        out = acc["at"].isNull() & _stopped(side, bar, stop)
        run = F.greatest(acc["run"], bar["high"]) if side == "long" else F.least(acc["run"], bar["low"])
        return F.struct(run.alias("run"), F.when(out, bar["j"]).otherwise(acc["at"]).alias("at"), F.when(out, _gap_fill(side, bar, stop)).otherwise(acc["price"]).alias("price"))

    end = _fold(state, step)
    price = F.coalesce(end["price"], _last()["close"])
    ret = _ret(price, side)
    return F.when(price > 0, _outcome(ret > 0, F.when(end["at"].isNull(), "timeout").otherwise("trail"), F.coalesce(end["at"] + 1, F.size("path")), ret))


def scaled(first: float = 2.5, multiple: float = 3.0, stop: float = STOP) -> Column:
    """Half is sold at ``first`` ATRs; the rest then trails, from the next bar. Before, a hard stop guards all of it."""
    hard = F.col("entry_price") - stop * F.col("atr14")
    bank = F.col("entry_price") + first * F.col("atr14")
    none = F.lit(None).cast("double")
    state = F.struct(F.lit(False).alias("half"), bank.alias("run"), F.lit(None).cast("int").alias("at"), none.alias("price"))

    def step(acc, bar):
        level = F.when(acc["half"], F.greatest(acc["run"] - multiple * F.col("atr14"), hard)).otherwise(hard)
        out = acc["at"].isNull() & (bar["low"] <= level)
        open_ = acc["at"].isNull() & ~out
        return F.struct(
            (acc["half"] | (open_ & (bar["high"] >= bank))).alias("half"),
            F.when(open_ & acc["half"], F.greatest(acc["run"], bar["high"])).otherwise(acc["run"]).alias("run"),
            F.when(out, bar["j"]).otherwise(acc["at"]).alias("at"),
            F.when(out, F.least(level, bar["open"])).otherwise(acc["price"]).alias("price"),
        )

    end = _fold(state, step)
    rest = F.coalesce(end["price"], _last()["close"]) / F.col("entry_price") - 1
    ret = F.when(end["half"], 0.5 * (bank / F.col("entry_price") - 1) + 0.5 * rest).otherwise(rest)
    name = F.when(end["half"], F.when(end["at"].isNull(), "scaled_timeout").otherwise("scaled")).otherwise(F.when(end["at"].isNull(), "timeout").otherwise("sl"))
    label = F.when(end["half"] | end["at"].isNull(), ret > 0).otherwise(F.lit(False))
    return _outcome(label, name, F.coalesce(end["at"] + 1, F.size("path")), ret)


def breakeven(target: float = TARGET, stop: float = STOP, trigger: float = 1.5) -> Column:
    """Target and stop; once ``trigger`` ATRs were reached the stop is the entry price, from the next bar."""
    e, atr = F.col("entry_price"), F.col("atr14")
    state = F.struct(F.lit(False).alias("armed"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("price"))

    def step(acc, bar):
        level = F.when(acc["armed"], e).otherwise(e - stop * atr)
        open_ = acc["at"].isNull()
        out = open_ & (bar["low"] <= level)
        win = open_ & ~out & (bar["high"] >= e + target * atr)
        return F.struct(
            (acc["armed"] | (open_ & ~out & ~win & (bar["high"] >= e + trigger * atr))).alias("armed"),
            F.when(out | win, bar["j"]).otherwise(acc["at"]).alias("at"),
            F.when(out, F.when(acc["armed"], "be").otherwise("sl")).when(win, "tp").otherwise(acc["name"]).alias("name"),
            F.when(out, F.least(level, bar["open"])).when(win, e + target * atr).otherwise(acc["price"]).alias("price"),
        )

    end = _fold(state, step)
    ret = F.coalesce(end["price"], _last()["close"]) / e - 1
    return _outcome((F.col("entry_price").isNotNull() & (end["name"].eqNullSafe("tp"))) | (ret > 0), F.coalesce(end["name"], F.lit("timeout")), F.coalesce(end["at"] + 1, F.size("path")), ret)


def average_exit(average: str = "ema21", side: str = "long") -> Column:
    """The first close beyond a moving average, which the path must hold."""
    at = _first(lambda b: b["close"] < b[average] if side == "long" else b["close"] > b[average])
    price = F.coalesce(F.get(F.filter("path", lambda b: b["j"] == at), F.lit(0))["close"], _last()["close"])
    ret = _ret(price, side)
    return F.when(price > 0, _outcome(ret > 0, F.when(at.isNull(), "timeout").otherwise("ma_exit"), F.coalesce(at + 1, F.size("path")), ret))


def structure_exit(side: str = "long", dense: float = 0.0028) -> Column:
    """The first close beyond the middle of the cluster, or the first dense bar; the path holds cluster_max, cluster_min
    and fast_spread."""
    middle = lambda b: (b["cluster_max"] + b["cluster_min"]) / 2
    at = _first(lambda b: (b["close"] < middle(b) if side == "long" else b["close"] > middle(b)) | (b["fast_spread"] <= dense))
    price = F.coalesce(F.get(F.filter("path", lambda b: b["j"] == at), F.lit(0))["close"], _last()["close"])
    ret = _ret(price, side)
    return F.when(price > 0, _outcome(ret > 0, F.when(at.isNull(), "timeout").otherwise("structure"), F.coalesce(at + 1, F.size("path")), ret))


def time_stop(bars: int, side: str = "long") -> Column:
    """The close of the n-th bar."""
    price = F.get("path", F.lit(bars - 1))["close"]
    ret = _ret(price, side)
    return F.when(price > 0, _outcome(ret > 0, "time_stop", F.lit(bars), ret))


def stop_only(stop: float = STOP, side: str = "long") -> Column:
    """A fixed stop, filled at the open of a bar that opens beyond it."""
    sign = 1 if side == "long" else -1
    level = F.col("entry_price") - sign * stop * F.col("atr14")
    hit = F.get(F.filter("path", lambda b: _stopped(side, b, level)), F.lit(0))
    price = F.coalesce(_gap_fill(side, hit, level), _last()["close"])
    price = F.when(hit.isNull(), _last()["close"]).otherwise(price)
    ret = _ret(price, side)
    return F.when(price > 0, _outcome(ret > 0, F.when(hit.isNull(), "timeout").otherwise("sl"), F.coalesce(hit["j"] + 1, F.size("path")), ret))


def time_decay(target: float = TARGET, stop: float = STOP, every: int = 12, by: float = 0.25) -> Column:
    """Target and a stop that comes ``by`` ATRs nearer every ``every`` bars; the stop counts first."""
    e, atr = F.col("entry_price"), F.col("atr14")
    level = lambda b: e - F.greatest(F.lit(stop) - by * F.floor(b["j"] / every), F.lit(0.0)) * atr
    up = _first(lambda b: b["high"] >= e + target * atr)
    hit = F.get(F.filter("path", lambda b: b["low"] <= level(b)), F.lit(0))
    lost = hit.isNotNull() & (up.isNull() | (hit["j"] <= up))
    down = F.least(level(hit), hit["open"]) / e - 1
    late = _last()["close"] / e - 1
    return (
        F.when(lost, _outcome(down > 0, "sl_decay", hit["j"] + 1, down))
        .when(up.isNotNull(), _outcome(F.lit(1), "tp", up + 1, (e + target * atr) / e - 1))
        .otherwise(_outcome(late > 0, "timeout", F.size("path"), late))
    )


def by_volatility(low: float, high: float, targets: tuple[float, float, float] = (4.0, 5.0, 6.0), stops: tuple[float, float, float] = (1.6, 2.0, 2.4), side: str = "long") -> Column:
    """The triple barrier with multiples by the tertile of atr_pct; a missing or infinite value counts as the middle one."""
    atr = finite("atr_pct")
    pick = lambda x: F.when(atr <= low, x[0]).when(atr > high, x[2]).otherwise(x[1])
    return triple_barrier(pick(targets), pick(stops), side)


#: Exits by name, to be set side by side.
EXITS: dict[str, Callable[..., Column]] = {
    "triple": triple_barrier, "trailing": trailing, "scaled": scaled, "breakeven": breakeven, "ma_exit": average_exit, "structure": structure_exit,
    "time_stop": time_stop, "stop_only": stop_only, "time_decay": time_decay, "vol_adaptive": by_volatility,
}


def exit_named(name: str, **parameters) -> Column:
    if name not in EXITS:
        raise KeyError(f"{name!r} is no exit; the exits are {', '.join(EXITS)}")
    return EXITS[name](**parameters)


def maker_filled(side: str = "long") -> Column:
    """Whether a resting order at the next open would have been filled: the bar trades strictly beyond its open."""
    bar = F.get("path", F.lit(0))
    return bar["low"] < bar["open"] if side == "long" else bar["high"] > bar["open"]
