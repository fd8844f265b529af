"""Named queries of signals: tips, launches, directions, straddles, schedules, regimes and checked joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ewm, six_means
from ..functions import indicators as ind
from ..operators import barriers, joins, metrics, portfolio, regime, selection, signals
from .queries import HORIZON, _bars, _dense, _rounded, _signals, _table, _trades

SPREAD = 0.004


def _tips(spark, d):
    return signals.with_tips(ind.with_indicators(_bars(spark, d)), F.col("fast_spread") <= SPREAD)


def dense_tips(spark, d):
    return _tips(spark, d).where("tip").select("symbol", "bar_i")


def launch_signals(spark, d):
    return signals.launches(_tips(spark, d), warmup=60)


def direction_votes(spark, d):
    rows = ewm.with_ewm(ind.with_averages(_bars(spark, d)), {"ema120": ("close", ewm.span(120))})
    rules = signals.direction_rules() | {"all_means": signals.all_average_rule(["ema8", "ema21", "ema55", "ema200"])}
    return rows.select("symbol", "bar_i", *(c.cast("int").alias(n) for n, c in rules.items()))


def segments_trimmed(spark, d):
    rows = _dense(ind.with_averages(_bars(spark, d))).withColumn("spread", F.round("spread", 9))
    return selection.trimmed(selection.segments(rows, F.col("spread") <= 0.01), rows, "spread")


def top_signals(spark, d):
    rows = _signals(ind.with_averages(_bars(spark, d))).select("symbol", "bar_i", F.round("atr_pct", 9).alias("atr_pct"))
    return signals.top_fraction(rows, "atr_pct", 0.2, ("symbol",))


def scan_windows(spark, d):
    return signals.window_schedule(_bars(spark, d))


def maker_fills(spark, d):
    return _trades(spark, d, barriers.triple_barrier()).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("maker").alias("filled"))


def _ranged(spark, d):
    """Signals with the range of the 20 bars up to them."""
    averaged = ind.with_averages(_bars(spark, d))
    w = selection.Window.partitionBy("symbol").orderBy("bar_i").rowsBetween(-19, 0)
    ranges = averaged.select("symbol", "bar_i", F.max("high").over(w).alias("range_high"), F.min("low").over(w).alias("range_low"))
    return barriers.with_path(_signals(averaged).join(ranges, ["symbol", "bar_i"]), averaged, HORIZON)


def _straddled(spark, d, fade):
    rows = _ranged(spark, d).withColumn("o", signals.straddle(fade=fade))
    return rows.select("symbol", "bar_i", "o.state", "o.direction", F.round("o.gross", 6).alias("gross"))


def straddle_outcomes(spark, d):
    return _straddled(spark, d, False)


def fade_outcomes(spark, d):
    return _straddled(spark, d, True)


def oracle_sides(spark, d):
    return _rounded(_ranged(spark, d).withColumn("o", signals.oracle_direction()).select("symbol", "bar_i", "o.*"), ["symbol", "bar_i"], ["long", "short", "oracle"])


def cool_down_trades(spark, d):
    """Dense bars with a triple barrier, one trade of a symbol at a time, four bars after the last exit."""
    averaged = ind.with_averages(_bars(spark, d))
    rows = _dense(averaged).withColumn("ok", selection.feasible(averaged, 60, HORIZON)).where("ok and spread <= 0.01 and atr_pct >= 0.0015").select("symbol", "bar_i", "close", "atr14", "atr_pct")
    out = barriers.with_path(rows, averaged, HORIZON).withColumn("o", barriers.triple_barrier()).select("symbol", "bar_i", (F.col("bar_i") + F.col("o.exit_offset")).alias("exit_i"))
    return portfolio.cool_down(out)


def side_form_trades(spark, d):
    trades = _trades(spark, d, barriers.triple_barrier()).unionByName(_trades(spark, d, barriers.triple_barrier(side="short"), "short"))
    return signals.side_form(trades, 14, 5).select("symbol", "bar_i", "side", F.round("form", 6).alias("form"))


def regime_trades(spark, d):
    """Trades with the state of the leading series at their signal, and the bucket of its change over 96 bars."""
    bars = _bars(spark, d)
    lead = bars.where("symbol = 'view'")
    states = regime.volatility_regime(lead).select("open_time", "high")
    ret = lead.withColumn("ret", F.col("close") / F.lag("close", 96).over(selection.Window.partitionBy("symbol").orderBy("bar_i")) - 1).select("open_time", regime.trend_bucket(F.col("ret")).alias("bucket"))
    times = bars.select("symbol", "bar_i", "open_time")
    rows = _trades(spark, d, barriers.triple_barrier()).join(times, ["symbol", "bar_i"]).withColumnRenamed("open_time", "signal_time")
    rows = regime.with_state(rows, states, "signal_time", "high_volatility")
    rows = rows.join(ret.withColumnRenamed("open_time", "signal_time"), "signal_time", "left")
    return rows.select("symbol", "bar_i", "high_volatility", F.coalesce("bucket", F.lit("unknown")).alias("bucket"), F.round("realized_ret", 6).alias("realized_ret"))


_SIX = ["fast_spread", "full_spread", "fast_slow_gap", "full_ratio_min48", "slow_slope_12", "ext_up", "shape_score"]


def six_mean_candidates(spark, d):
    rows = six_means.with_six_means(_bars(spark, d)).withColumn("candidate", six_means.six_mean_mask())
    return _rounded(rows, ["symbol", "bar_i", "order_score", "down_order_score", "trend_order_score", "dense_run", "candidate"], _SIX)


def orders_checked(spark, d):
    """Orders with their customer's segment, which must be one row a customer; others are called unknown."""
    customers = _table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.checked_join(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"], {"c_mktsegment": "unknown"})


def customers_flagged(spark, d):
    orders = _table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flagged(_table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], "large")


NOW = "2024-01-20 12:00:00"


def _signal_log(spark, d):
    rows = _table(spark, d, "events").where("ts is not null and event_type is not null")
    log = rows.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("signal_time"), (F.col("value") / 100).alias("score"), F.when(F.col("value") < 50, "new").otherwise("open").alias("status"))
    return log.groupBy("symbol", "signal_time").agg(F.max("score").alias("score"), F.max("status").alias("status"))


def guarded_signals(spark, d):
    """A pulse's signals, of which those of the log's last day are known already."""
    log = _signal_log(spark, d)
    return signals.gap_guarded(log.where("signal_time >= timestamp_ntz'2024-01-15 00:00:00'"), log.where("signal_time < timestamp_ntz'2024-01-16 00:00:00'"), 4 * 3600)


def actionable_signals(spark, d):
    return signals.actionable(_signal_log(spark, d), ("new",), 0.2, 24 * 60, F.lit(NOW))


def expired_positions(spark, d):
    rows = _signal_log(spark, d).where("status = 'open'")
    return rows.groupBy("symbol").agg(F.count_if(signals.timed_out(rows, 18.0, F.lit(NOW), "signal_time")).alias("expired"), F.count("*").alias("n"))


def _outcomes_of(spark, d, rows, averaged):
    return barriers.with_path(rows, averaged, HORIZON).withColumn("o", barriers.triple_barrier()).select("symbol", "bar_i", "o.*")


def base_rate_dense(spark, d):
    """Dense signals against as many bars of each series that chance has picked."""
    averaged = ind.with_averages(_bars(spark, d))
    fit = averaged.withColumn("ok", selection.feasible(averaged, 60, HORIZON)).where("ok and atr_pct >= 0.0015").select("symbol", "bar_i", "close", "atr14", "atr_pct")
    chosen = _signals(averaged)
    return metrics.base_rate(_outcomes_of(spark, d, chosen, averaged), _outcomes_of(spark, d, signals.control_sample(fit, chosen), averaged), 0.0006)


def pool_summary(spark, d):
    return metrics.build_summary(_trades(spark, d, barriers.triple_barrier()), "entry_time", "outcome", "label")


_RULE_FEATURES = ["fast_spread", "full_spread", "fast_slow_gap", "pre_range48", "pre_range168", "drawdown24", "runup24", "ext_up", "slow_slope_12", "volume_ratio"]


def causal_rule(spark, d):
    """What tells bars before a rise of 24 bars from those before a fall."""
    rows = ind.with_indicators(_bars(spark, d))
    ahead = F.lead("close", 24).over(selection.Window.partitionBy("symbol").orderBy("bar_i")) / F.col("close") - 1
    rows = rows.withColumn("ahead", ahead).where("ahead is not null").withColumns({f: F.round(f, 9) for f in _RULE_FEATURES})
    return metrics.and_rule(rows, _RULE_FEATURES, "ahead")


SIGNAL_QUERIES = {
    f.__name__: f
    for f in (
        dense_tips, launch_signals, direction_votes, segments_trimmed, top_signals, scan_windows, maker_fills, straddle_outcomes, fade_outcomes, oracle_sides, cool_down_trades, side_form_trades, regime_trades,
        six_mean_candidates, orders_checked, customers_flagged, guarded_signals, actionable_signals, expired_positions, base_rate_dense, pool_summary, causal_rule,
    )
}
