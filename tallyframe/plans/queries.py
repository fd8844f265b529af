"""Named queries over the driver's tables, one or more for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ewm, rich, scalars, windows
from ..functions import indicators as ind
from ..operators import barriers, joins, metrics, models, outcomes, portfolio, selection
from ..sources import bars as src
from ..sources import records as from_records
from ..streaming import records

WARMUP, HORIZON, GAP, COST = 60, 24, 18, 0.003


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bars(spark: SparkSession, d: str, width: str = "1 hour") -> DataFrame:
    return src.event_bars(_table(spark, d, "events"), width)


def _rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *((F.round(n, 6) + 0.0).alias(n) for n in names))  # no negative zeros


def bars_1h(spark, d):
    return _bars(spark, d).select("symbol", "open_time", "open", "high", "low", "close", "volume", "bar_i")


def bars_4h_resampled(spark, d):
    return src.resampled(_bars(spark, d), "4 hours").select("symbol", "open_time", "open", "high", "low", "close", "volume", "bar_i")


def bars_audit(spark, d):
    return src.audit(_bars(spark, d), src.width_seconds("1H"), now=F.lit("2024-02-01 12:00:00"))


def shipments_keep_last(spark, d):
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    rows = src.keep_last(_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


def averages(spark, d):
    return _rounded(ind.with_averages(_bars(spark, d)), ["symbol", "bar_i"], [*(f"ema{n}" for n in ind.SPANS), "atr14", "atr_pct"])


_INDICATORS = ["volume_z", "volume_ratio", "fast_spread", "full_spread", "fast_slow_gap", "full_ratio_min48", "pre_range48", "pre_range168", "drawdown24", "runup24", "ext_up", "ext_down", "slow_slope_12", "zero_volume96", "shape_score"]


def indicators(spark, d):
    return _rounded(ind.with_indicators(_bars(spark, d)), ["symbol", "bar_i", "order_score", "down_order_score"], _INDICATORS)


def features(spark, d):
    whole = ["dense_run_len", "order_score"]
    return _rounded(ind.with_features(ind.with_indicators(_bars(spark, d))), ["symbol", "bar_i", *whole], [f for f in ind.FEATURES if f not in whole])


def _rich(spark: SparkSession, d: str) -> DataFrame:
    return rich.with_rich(ind.with_features(ind.with_indicators(_bars(spark, d))))


def rich_features(spark, d):
    return _rounded(_rich(spark, d), ["symbol", "bar_i"], list(rich.RICH))


def break_quality(spark, d):
    """Bars with all means: how good a break of the bundle of six is, on either side."""
    rows = _rich(spark, d).where("sma120 is not null")
    bundle = [f"{k}{p}" for k in ("sma", "ema") for p in (20, 60, 120)]
    sides = [rich.breakdown_quality(rows, bundle, side).withColumn("side", F.lit(side)) for side in ("short", "long")]
    return _rounded(sides[0].unionByName(sides[1]), ["symbol", "bar_i", "side"], ["bd_depth", "bd_force", "bd_range", "vol_break", "ma_roll", "steps20", "from_extreme20", "room48", "fall20"])


def factors(spark, d):
    names = [n for n in ind.FACTORS if n != "vp_corr"]
    return _rounded(ind.with_factors(ind.with_indicators(_bars(spark, d)), names), ["symbol", "bar_i"], names)


def factor_vp_corr(spark, d):
    return _rounded(ind.with_factors(ind.with_indicators(_bars(spark, d)), ["vp_corr"]), ["symbol", "bar_i"], ["vp_corr"])


def _dense(averaged: DataFrame) -> DataFrame:
    three = [F.col(c) for c in ("ema8", "ema21", "ema55")]
    spread = (F.greatest(*three) - F.least(*three)) / F.nullif(F.col("close"), F.lit(0.0))
    return averaged.withColumn("spread", spread)


def _signals(averaged: DataFrame) -> DataFrame:
    rows = _dense(averaged).withColumn("ok", selection.feasible(averaged, WARMUP, HORIZON))
    hits = rows.where("ok and spread <= 0.01 and atr_pct >= 0.0015").select("symbol", "bar_i", "close", "atr14", "atr_pct")
    return selection.min_gap(hits, GAP)


def dense_signals(spark, d):
    return _rounded(_signals(ind.with_averages(_bars(spark, d))), ["symbol", "bar_i"], ["close", "atr14"])


def _trades(spark, d, exit_, side="long", extra=()):
    averaged = ind.with_averages(_bars(spark, d))
    if extra:
        averaged = ind.with_indicators(_bars(spark, d))
    paths = barriers.with_path(_signals(averaged), averaged, HORIZON, extra=extra)
    out = paths.withColumn("o", exit_).where("o is not null").select("symbol", "bar_i", "atr_pct", barriers.maker_filled(side).alias("maker"), "o.*")
    times = averaged.select("symbol", (F.col("bar_i") - 1).alias("bar_i"), F.col("open_time").alias("entry_time"))
    out = out.join(times, ["symbol", "bar_i"])
    return out.withColumn("exit_time", F.col("entry_time") + F.make_dt_interval(hours=F.col("exit_offset"))).withColumn("side", F.lit(side))


def _outcome_rows(trades):
    return trades.select("symbol", "bar_i", "outcome", "exit_offset", F.round("entry_price", 6).alias("entry_price"), F.round("realized_ret", 6).alias("realized_ret"))


def barrier_long(spark, d):
    return _outcome_rows(_trades(spark, d, barriers.triple_barrier()))


def barrier_short(spark, d):
    return _outcome_rows(_trades(spark, d, barriers.triple_barrier(side="short"), "short"))


def _exits(spark: SparkSession, d: str) -> DataFrame:
    """Every exit on the same paths, one row a signal and exit."""
    enriched = ind.with_indicators(_bars(spark, d))
    paths = barriers.with_path(_signals(enriched), enriched, HORIZON, extra=("ema21", "cluster_max", "cluster_min", "fast_spread"))
    more = {"time_stop": {"bars": 12}, "vol_adaptive": {"low": 0.004, "high": 0.008, "targets": (3.0, 5.0, 6.0), "stops": (1.5, 2.0, 2.5)}}
    all_ = F.array(*(F.struct(F.lit(n).alias("exit"), barriers.exit_named(n, **more.get(n, {})).cast(barriers.OUTCOME).alias("o")) for n in barriers.EXITS))
    return paths.select("symbol", "bar_i", F.explode(all_).alias("x")).where("x.o is not null").select("symbol", "bar_i", "x.exit", "x.o.*")


def exit_variants(spark, d):
    return _exits(spark, d).select("symbol", "bar_i", "exit", "label", "outcome", "exit_offset", F.round("entry_price", 6).alias("entry_price"), F.round("realized_ret", 6).alias("realized_ret"))


def exit_metrics(spark, d):
    """Every exit side by side: number, share of gains, mean net and profit factor after the maker's cost."""
    net = F.col("realized_ret") - scalars.COSTS["swap_maker"]
    rows = _exits(spark, d).groupBy("exit").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("positive"), F.round(F.avg(net), 6).alias("mean_net"), F.round(metrics.profit_factor(net), 6).alias("profit_factor"))
    return rows


def candidate_gates(spark, d):
    """Which bars pass the gates of either preset on either side."""
    masks = {f"{mode}_{side}": ind.candidate_mask(mode, side) for mode in ("strict", "expanded") for side in ("long", "short")}
    return ind.with_indicators(_bars(spark, d)).select("symbol", "bar_i", *(m.alias(n) for n, m in masks.items()))


def barrier_metrics(spark, d):
    return metrics.trade_metrics(_trades(spark, d, barriers.triple_barrier()), COST, ("symbol",))


def _open_paths(spark: SparkSession, d: str) -> DataFrame:
    """Dense bars up to the newest one, whose outcomes may still be open."""
    averaged = ind.with_averages(_bars(spark, d))
    hits = _dense(averaged).where((F.col("bar_i") >= WARMUP) & (F.col("spread") <= 0.01) & (F.col("atr_pct") >= 0.0015)).select("symbol", "bar_i", "open_time", "close", "atr14", "atr_pct")
    return outcomes.with_open_path(selection.min_gap(hits, GAP), averaged, HORIZON)


def open_outcomes(spark, d):
    rows = _open_paths(spark, d).withColumn("o", outcomes.open_barrier(horizon=HORIZON)).withColumns(outcomes.entry_fields(src.width_seconds("1H")))
    return rows.select("symbol", "bar_i", "o.status", "o.outcome", "o.label", "o.exit_offset", F.round("o.realized_ret", 6).alias("realized_ret"), "pending", F.round("entry_shown", 6).alias("entry_shown"), F.col("maker_filled").cast("int").alias("maker_filled"))


def open_scaled_outcomes(spark, d):
    rows = _open_paths(spark, d).withColumn("o", outcomes.open_scaled(horizon=HORIZON))
    return rows.select("symbol", "bar_i", "o.status", "o.outcome", "o.label", "o.exit_offset", F.round("o.realized_ret", 6).alias("realized_ret"))


def _forward_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return _table(spark, d, "events").select(
        kind.alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("signal_time"), F.col("ts").alias("detected_at"), F.when(kind == "error", "open").otherwise("closed").alias("status"),
        F.when(kind == "view", "").otherwise(kind).alias("outcome"), ((F.col("value") - 50) / 1000).alias("realized_ret"), (kind != "signup").alias("maker_filled"),
    )


def forward_decision(spark, d):
    return outcomes.forward_summary(_forward_log(spark, d), scalars.COSTS["swap_maker"])


def forward_outcomes(spark, d):
    return outcomes.outcome_rows(_forward_log(spark, d), scalars.COSTS["swap_maker"])


def tracked_signals(spark, d):
    log = _forward_log(spark, d)
    return outcomes.with_tracked(log.where("detected_at >= timestamp_ntz'2024-01-15 00:00:00'"), log)


def trade_excursions(spark, d):
    averaged = ind.with_averages(_bars(spark, d))
    rows = barriers.with_path(_signals(averaged), averaged, HORIZON).withColumns(outcomes.excursions(scalars.COSTS["swap_maker"]))
    return _rounded(rows, ["symbol", "bar_i"], list(outcomes.EXCURSIONS))


def excursion_metrics(spark, d):
    averaged = ind.with_averages(_bars(spark, d))
    rows = barriers.with_path(_signals(averaged), averaged, HORIZON).withColumns(outcomes.excursions(scalars.COSTS["swap_maker"]))
    return outcomes.excursion_summary(rows, "symbol")


def weighted_trades(spark, d):
    trades = _trades(spark, d, barriers.triple_barrier()).withColumn("weight", 1 + F.col("bar_i") % 3 * 0.5)
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-25 00:00:00"))
    return outcomes.weighted_metrics(trades, scalars.COSTS["swap_taker"], low, high)


def trades_by_month(spark, d):
    return metrics.by_period(_trades(spark, d, barriers.triple_barrier()), "exit_time", COST)


def side_cost_grid(spark, d):
    both = _trades(spark, d, barriers.triple_barrier()).unionByName(_trades(spark, d, barriers.triple_barrier(side="short"), "short"))
    return metrics.cost_grid(both, {"gross": 0.0, "maker": 0.001, "taker": 0.003})


def portfolio_replay(spark, d):
    trades = _trades(spark, d, barriers.triple_barrier()).withColumn("score", F.round("atr_pct", 9))
    return portfolio.replay(trades, 0.0, 3).select("symbol", "bar_i", "entry_time", "exit_time", F.round("realized_ret", 6).alias("realized_ret"))


def signals_asof_trend(spark, d):
    hours = _bars(spark, d).select("symbol", (F.col("open_time") + F.expr("interval 1 hour")).alias("closed_at"), F.col("close").alias("hour_close"))
    trades = _trades(spark, d, barriers.triple_barrier()).select("symbol", "bar_i", "entry_time")
    return joins.asof_join(trades, hours, ["symbol"], "entry_time", "closed_at", ["hour_close"])


def orders_in_trades(spark, d):
    orders = _table(spark, d, "orders").select(F.lit(1).alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"), F.round("o_totalprice").cast("double").alias("v"))
    trades = _trades(spark, d, barriers.triple_barrier()).withColumn("k", F.lit(1))
    return joins.range_sum(trades, orders, ["k"], "entry_time", "exit_time", "t", "v", "settled").select("symbol", "bar_i", "settled")


def _two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every event stands on one side: clicks and views, and all others."""
    events = _table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    first = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    return events.where(first), events.where(~first)


def events_without_neighbour(spark, d):
    """Clicks and views of a user without any other event of that user within an hour."""
    seen, done = _two_sides(spark, d)
    return joins.nearest_anti(seen, done, ["user_id"], "ts", 3600.0)


def value_deciles(spark, d):
    return metrics.deciles(_table(spark, d, "events"), "value", "user_id")


def quality_ranking(spark, d):
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.ranking(rows, "quality", "n_chars")


def dense_segments(spark, d):
    rows = _dense(ind.with_averages(_bars(spark, d)))
    return selection.segments(rows, F.col("spread") <= 0.01)


def factor_screen(spark, d):
    rows = ind.with_factors(ind.with_indicators(_bars(spark, d)))
    ahead = F.lead("close", 4).over(Window.partitionBy("symbol").orderBy("bar_i")) / F.col("close") - 1
    rows = rows.withColumn("ahead", ahead).withColumns({f: F.round(f, 9) for f in ind.FACTORS})  # sums in another order rank alike
    return metrics.factor_screen(rows, list(ind.FACTORS), "ahead", "open_time")


def strict_candidates(spark, d):
    """Candidates of the expanded gates widened for this walk, best shape first, at least 18 bars apart."""
    wide = {k: v * 12 if isinstance(v, float) and k != "volume_ratio" else v for k, v in ind.GATES["expanded"].items()} | {"ext": (-0.05, 0.05), "order": 2}
    rows = ind.with_indicators(_bars(spark, d))
    rows = rows.withColumn("ok", selection.feasible(rows, 168, HORIZON)).where(F.col("ok") & ind.candidate_mask(gates=wide))
    return selection.greedy_gap(rows.select("symbol", "bar_i", F.round("shape_score", 6).alias("shape_score")), "shape_score", GAP)


def forward_merge(spark, d):
    keyed = _table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("signal_time"), "event_id", "value", (F.col("user_id") % 2 == 0).alias("closed"))
    first = lambda x: src.keep_last(x, ["symbol", "signal_time"], [-F.col("event_id")]).select("symbol", "signal_time", "value", "closed")
    return records.merged(first(keyed.where("event_id % 3 <> 0")), first(keyed.where("event_id % 3 <> 1")), ("symbol", "signal_time"))


def events_overlap(spark, d):
    """Clicks and views against all other events of the same users: who has a partner within an hour."""
    seen, done = _two_sides(spark, d)
    return joins.overlap(seen, done, ["user_id"], "ts", 3600.0)


def orders_reconciled(spark, d):
    orders = _table(spark, d, "orders")
    a = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_totalprice")
    b = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return joins.reconciled(a, b, ["o_orderkey"], "o_totalprice")


def month_concentration(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_orderdate").alias("exit_time"), ((F.col("o_orderkey") % 200 - 97) / 1000.0).alias("realized_ret"))
    return metrics.concentration(metrics.by_period(orders, "exit_time", COST), 20)


def quarter_metrics(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_orderdate").alias("exit_time"), ((F.col("o_orderkey") % 200 - 97) / 1000.0).alias("realized_ret"))
    return metrics.by_period(orders, "exit_time", COST, "quarter")


def equity_points(spark, d):
    trades = _trades(spark, d, barriers.triple_barrier())
    run = metrics.equity(trades, F.col("realized_ret") - COST, ["exit_time", "symbol", "bar_i"], ("symbol",), 0.0)
    last = run.groupBy("symbol", "exit_time").agg(F.max_by("equity", "bar_i").alias("equity"), F.max_by("peak", "bar_i").alias("peak"))
    return last.select("symbol", "exit_time", (F.round("equity", 6) + 0.0).alias("equity"), (F.round(F.col("peak") - F.col("equity"), 6) + 0.0).alias("drawdown"))


def trade_utilisation(spark, d):
    trades = _trades(spark, d, barriers.triple_barrier()).withColumn("weight", F.lit(1.0))
    bounds = trades.agg(F.min("entry_time").alias("lo"), F.max("exit_time").alias("hi")).first()
    low, high = (F.lit(x) if x is not None else F.lit(None).cast("timestamp_ntz") for x in bounds)
    return metrics.utilisation(trades, "entry_time", "exit_time", "weight", low, high)


def user_loss_runs(spark, d):
    ledger = _table(spark, d, "events").select("user_id", "event_id", (F.col("value") - 50).alias("ret"))
    return from_records.consecutive_losses(ledger, ["user_id"], "event_id", "ret")


def props_parsed(spark, d):
    rows = _table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


def fresh_signals(spark, d):
    log = _table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("signal_time"), F.col("ts").alias("detected_at"))
    return records.live(log).select("event_id", F.round("lag_min", 6).alias("lag_min"), "is_live")


def split_events(spark, d):
    rows = models.time_split(_table(spark, d, "events").select("event_id", "ts"), "ts", 3600, order="event_id")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def segment_top_customers(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = _table(spark, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return ranked.select("c_mktsegment", "rank", "c_custkey", "c_acctbal", scalars.tier(F.col("c_acctbal"), F.lit(0.0), F.lit(9000.0), F.lit(9900.0)).alias("tier"))


def rising_runs(spark, d):
    bars = _bars(spark, d)
    w = windows.series()
    up = F.col("close") > F.lag("close").over(w)
    return bars.withColumn("up", up).select("symbol", "bar_i", windows.run_length(F.col("up"), w).alias("run"), windows.filled(F.when(F.col("volume") > 3, F.col("close")), 3, w).alias("filled"))


def hourly_trend(spark, d):
    """Four-hour closes with their means of 55 and 144 and the change over 12, as of the last finished bar."""
    wide = ewm.with_ewm(src.resampled(_bars(spark, d), "4 hours"), {"m55": ("close", ewm.span(55)), "m144": ("close", ewm.span(144))})
    slope = F.col("m55") - F.lag("m55", 12).over(windows.series())
    return _rounded(wide.withColumn("slope", slope), ["symbol", "bar_i"], ["m55", "m144", "slope"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bars_1h, bars_4h_resampled, bars_audit, shipments_keep_last, averages, indicators, features, rich_features, break_quality, factors, factor_vp_corr, dense_signals, strict_candidates, dense_segments, barrier_long, barrier_short,
        exit_variants, exit_metrics, candidate_gates, open_outcomes, open_scaled_outcomes, forward_decision, forward_outcomes, tracked_signals, trade_excursions, excursion_metrics, weighted_trades, barrier_metrics, trades_by_month, side_cost_grid, portfolio_replay, signals_asof_trend, orders_in_trades, events_without_neighbour, value_deciles, quality_ranking, factor_screen, forward_merge,
        events_overlap, orders_reconciled, month_concentration, quarter_metrics, equity_points, trade_utilisation, user_loss_runs, props_parsed, fresh_signals, split_events, segment_top_customers, rising_runs, hourly_trend,
    )
}
