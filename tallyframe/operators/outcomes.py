"""Outcomes while they are still open, what trades went through on their way, and metrics of a forward log.

Unlike in ``barriers``, a signal whose path isn't full yet is kept: it is open until a barrier is touched or the horizon
has passed, and pending while not even the bar of its entry is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .barriers import HORIZON, LEAST_ATR, STOP, TARGET
from .metrics import CAPITAL, equity, profit_factor, utilisation

# Minutes from a signal to its detection up to which it counts as live, and trades that a decision needs.
FRESH_MINUTES, DECISION_TRADES = 30.0, 100
# Bars after which a return is noted; targets and stops of the tight exits; the least bars of a path.
RETURN_BARS, TIGHT_TARGETS, TIGHT_STOPS, LEAST_PATH = (4, 8, 12, 24, 48), (1.0, 2.0, 3.0), (1.0, 1.5), 8


def with_open_path(signals: DataFrame, bars: DataFrame, horizon: int = HORIZON, least_atr: float = LEAST_ATR, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Signals with ``path``, the bars after them up to ``horizon``, as many as there are, ``entry_price`` (the first one's
    open; NULL while pending) and ``pending``. Signals without a positive ATR, a relative ATR of ``least_atr`` or a positive
    price are left out."""
    fit = (F.col("atr14") > 0) & ~F.isnan("atr14") & (F.col("atr_pct") >= least_atr)
    asked = signals.where(F.coalesce(fit, F.lit(False)))
    each = asked.select(*keys, "bar_i", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("j")).withColumn("_at", F.col("bar_i") + 1 + F.col("j"))
    met = each.join(bars.select(*keys, F.col("bar_i").alias("_at"), "open_time", "open", "high", "low", "close"), [*keys, "_at"])
    paths = met.groupBy(*keys, "bar_i").agg(F.array_sort(F.collect_list(F.struct("j", "open", "high", "low", "close", "open_time"))).alias("path"))
    rows = asked.join(paths, [*keys, "bar_i"], "left").withColumn("pending", F.col("path").isNull())
    rows = rows.withColumn("entry_price", F.get("path", F.lit(0))["open"])
    return rows.where(F.col("pending") | (F.col("entry_price") > 0))


def _state(status: Column | str, outcome: Column | str, label: Column | int, offset: Column | int, ret: Column | None) -> Column:
    put = lambda x: F.lit(x) if isinstance(x, str | int) else x
    ret = F.lit(None) if ret is None else ret
    return F.struct(put(status).alias("status"), put(outcome).alias("outcome"), put(label).cast("int").alias("label"), put(offset).cast("int").alias("exit_offset"), ret.cast("double").alias("realized_ret"))


def _open() -> Column:
    return _state("open", "", -1, 0, None)


def _first(condition) -> Column:
    return F.get(F.filter("path", condition), F.lit(0))


def open_barrier(target: float = TARGET, stop: float = STOP, horizon: int = HORIZON) -> Column:
    """(status, outcome, label, exit_offset, realized_ret) of a long trade: target or stop, the stop where both are touched
    in one bar; the last close once the horizon has passed; else open."""
    e, atr = F.col("entry_price"), F.col("atr14")
    up, down = e + target * atr, e - stop * atr
    u, d = _first(lambda b: b["high"] >= up)["j"], _first(lambda b: b["low"] <= down)["j"]
    return (
        F.when(u.isNotNull() & (d.isNull() | (u < d)), _state("closed", "tp", 1, u + 1, up / e - 1))
        .when(d.isNotNull(), _state("closed", F.when(u == d, "sl_ambiguous").otherwise("sl"), 0, d + 1, down / e - 1))
        .when(F.size("path") >= horizon, _state("closed", "timeout", 0, horizon, F.element_at("path", -1)["close"] / e - 1))
        .otherwise(_open())
    )


def open_scaled(first: float = 2.5, multiple: float = 3.0, stop: float = STOP, horizon: int = HORIZON) -> Column:
    """The same for the scaled exit: half is sold at ``first`` ATRs, the rest trails from the next bar; a hard stop guards."""
    e, atr = F.col("entry_price"), F.col("atr14")
    hard, bank = e - stop * atr, e + first * atr
    lost, half = _first(lambda b: b["low"] <= hard), _first(lambda b: b["high"] >= bank)
    early = lost["j"].isNotNull() & (half["j"].isNull() | (lost["j"] <= half["j"]))
    state = F.struct(bank.alias("run"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("price"))

    def step(acc: Column, bar: Column) -> Column:
        level = F.greatest(acc["run"] - multiple * atr, hard)
        out = acc["at"].isNull() & (bar["low"] <= level)
        return F.struct(
            F.greatest(acc["run"], bar["high"]).alias("run"), F.when(out, bar["j"]).otherwise(acc["at"]).alias("at"), F.when(out, F.least(level, bar["open"])).otherwise(acc["price"]).alias("price")
        )

    end = F.aggregate(F.filter("path", lambda b: b["j"] > half["j"]), state, step)
    banked = 0.5 * (bank / e - 1)
    sold, late = banked + 0.5 * (end["price"] / e - 1), F.element_at("path", -1)["close"] / e - 1
    over = F.size("path") >= horizon
    gain = lambda x: (x > 0).cast("int")
    return (
        F.when(early, _state("closed", "sl", 0, lost["j"] + 1, F.least(hard, lost["open"]) / e - 1))
        .when(half["j"].isNotNull() & end["at"].isNotNull(), _state("closed", "scaled", gain(sold), end["at"] + 1, sold))
        .when(over & half["j"].isNull(), _state("closed", "timeout", gain(late), horizon, late))
        .when(over, _state("closed", "scaled_timeout", gain(banked + 0.5 * late), horizon, banked + 0.5 * late))
        .otherwise(_open())
    )


def entry_fields(bar_seconds: int) -> dict[str, Column]:
    """The entry's time, price and whether a maker's order was filled. While the entry's bar is missing they are what is
    known: the signal bar's end, its close, and nothing. Columns: open_time and close of the signal, and its path."""
    bar = F.get("path", F.lit(0))
    return {
        "entry_time": F.when(F.col("pending"), F.col("open_time") + F.make_dt_interval(secs=F.lit(bar_seconds))).otherwise(bar["open_time"]),
        "entry_shown": F.when(F.col("pending"), F.col("close")).otherwise(bar["open"]),
        "maker_filled": F.when(~F.col("pending"), bar["low"] < bar["open"]),
    }


def with_tracked(found: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("symbol", "signal_time")) -> DataFrame:
    """The signals of this pulse and those of the log that are still open, each once, with ``tracked``."""
    still = log.where("status = 'open'").select(*keys).distinct().withColumn("tracked", F.lit(True))
    return found.select(*keys).distinct().join(still, list(keys), "full").withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def decidable(log: DataFrame, fresh: float = FRESH_MINUTES) -> Column:
    """Whether a row of a forward log counts: closed with a return, filled, and detected while it was live."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    lag = (seconds("detected_at") - seconds("signal_time")) / 60
    return F.coalesce((F.col("status") == "closed") & F.col("realized_ret").isNotNull() & F.col("maker_filled") & (lag <= fresh), F.lit(False))


def forward_summary(log: DataFrame, cost: float, fresh: float = FRESH_MINUTES, target: int = DECISION_TRADES) -> DataFrame:
    """One row: rows of the log, closed and open ones, trades that count, those still missing for a decision, those left out
    as hindsight, and the metrics of the trades that count (NULL without any, the profit factor also without losses)."""
    ok = decidable(log, fresh)
    closed = F.coalesce((F.col("status") == "closed") & F.col("realized_ret").isNotNull(), F.lit(False))
    filled = closed & F.coalesce("maker_filled", F.lit(False))
    net = F.when(ok, F.col("realized_ret") - cost)
    n = F.count(net)
    return log.agg(
        F.count("*").alias("total_rows"), F.count_if(closed).alias("closed_rows"), F.count_if(~F.col("status").eqNullSafe("closed")).alias("open_rows"), n.alias("n_trades"),
        F.greatest(F.lit(target) - n, F.lit(0)).alias("decision_remaining"), F.round(F.least(n / target, F.lit(1.0)), 4).alias("progress"), F.count_if(filled & ~ok).alias("hindsight_excluded"),
        F.round(profit_factor(net), 3).alias("profit_factor"), F.round(F.avg((net > 0).cast("double")), 4).alias("win_rate"), F.round(F.avg(net), 5).alias("mean_net"),
        F.round(F.sum(net) / CAPITAL, 4).alias("net_on_capital"), F.coalesce(F.round(F.sum(net), 5), F.lit(0.0)).alias("net_total"),
    )


def outcome_rows(log: DataFrame, cost: float, fresh: float = FRESH_MINUTES) -> DataFrame:
    """(outcome, n, net_percent) of the trades that count; an empty outcome is called open."""
    rows = log.where(decidable(log, fresh)).groupBy(F.coalesce(F.nullif("outcome", F.lit("")), F.lit("open")).alias("outcome"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum((F.col("realized_ret") - cost) * 100), 4).alias("net_percent"))


def _tight(target: float, stop: float) -> str:
    """The name of a tight exit's net; a dot would need quotes."""
    return f"net_tp{target:g}_sl{stop:g}".replace(".", "_")


#: The columns of ``excursions``.
EXCURSIONS = (*(f"ret{n}" for n in RETURN_BARS), "mfe", "mae", *(_tight(a, s) for a in TIGHT_TARGETS for s in TIGHT_STOPS))


def excursions(cost: float) -> dict[str, Column]:
    """What a long trade went through: returns after some bars (NULL on shorter paths), the best and the worst price, and the
    net of tight exits, the target first where both are touched. Paths of ``LEAST_PATH`` bars at least."""
    e, atr = F.col("entry_price"), F.col("atr14")
    out = {f"ret{n}": F.get("path", F.lit(n))["close"] / e - 1 for n in RETURN_BARS}
    out["mfe"] = F.array_max(F.transform("path", lambda b: b["high"])) / e - 1
    out["mae"] = F.array_min(F.transform("path", lambda b: b["low"])) / e - 1
    above = lambda price: _first(lambda b: b["high"] >= price)["j"]
    below = lambda price: _first(lambda b: b["low"] <= price)["j"]
    for a in TIGHT_TARGETS:
        for s in TIGHT_STOPS:
            u, d = above(e + a * atr), below(e - s * atr)
            gross = F.when(u.isNotNull() & (d.isNull() | (u <= d)), a * atr / e).when(d.isNotNull(), -s * atr / e).otherwise(F.element_at("path", -1)["close"] / e - 1)
            out[_tight(a, s)] = gross - cost
    return {k: F.when(F.size("path") >= LEAST_PATH, v) for k, v in out.items()}


def excursion_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a group: the number of trades, mean returns in hundredths of a percent, mean best and worst, and of each tight
    exit the win rate, profit factor and mean."""
    bps = lambda c: F.round(F.avg(c) * 1e4, 1)
    nets = [_tight(a, s) for a in TIGHT_TARGETS for s in TIGHT_STOPS]
    aggs = [F.count("mfe").alias("n"), *(bps(f"ret{n}").alias(f"ret{n}_bps") for n in RETURN_BARS), F.round(F.avg("mfe"), 4).alias("mfe_mean"), F.round(F.avg("mae"), 4).alias("mae_mean")]
    for c in nets:
        aggs += [F.round(F.avg((F.col(c) > 0).cast("double")), 3).alias(f"{c}_win"), F.round(profit_factor(F.col(c)), 3).alias(f"{c}_pf"), bps(c).alias(f"{c}_bps")]
    return rows.groupBy(*keys).agg(*aggs)


def weighted_metrics(trades: DataFrame, cost: float, low: Column, high: Column, weight: str = "weight", order: tuple[str, ...] = ("exit_time", "symbol", "bar_i")) -> DataFrame:
    """One row over the trades that enter from ``low`` up to ``high``: as ``trade_metrics``, each net times its weight, with
    the turnover and the utilisation of the capital in that time. No row without trades."""
    w = F.col(weight)
    inside = trades.where((F.col("entry_time") >= low) & (F.col("entry_time") < high))
    run = equity(inside, w * (F.col("realized_ret") - cost), list(order))
    net = F.col("net")
    days = (F.unix_seconds(high.cast("timestamp")) - F.unix_seconds(low.cast("timestamp"))) / 86_400
    out = run.agg(
        F.count("*").alias("n_trades"), F.round(F.sum(net), 4).alias("net_total"), F.round(F.sum(net) / CAPITAL, 4).alias("net_on_capital"), F.round(F.avg(net), 5).alias("mean_net"),
        F.round(F.avg((net > 0).cast("double")), 4).alias("win_rate"), F.round(profit_factor(net, float("inf")), 3).alias("profit_factor"), F.round(F.max((F.col("peak") - F.col("equity")) / F.col("peak")), 4).alias("max_drawdown"),
        F.round(F.sum(w), 2).alias("turnover"), F.round(F.sum(w) / F.first(days), 3).alias("turnover_per_day"), F.round(F.avg(w), 3).alias("mean_weight"), F.lit(1).alias("_one"),
    )
    used = utilisation(inside, "entry_time", "exit_time", weight, low, high).select(F.round(F.col("utilisation") / CAPITAL, 4).alias("utilisation"), F.lit(1).alias("_one"))
    return out.join(used, "_one").where("n_trades > 0").drop("_one")
