"""Operators on small hand-made frames, against plain Python where SQL has no answer."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyframe.functions import ewm, indicators, windows
from tallyframe.operators import barriers, joins, metrics, portfolio, selection
from tallyframe.sources import bars as src
from tallyframe.streaming import records

T0 = dt.datetime(2024, 1, 1)


def path_frame(spark, changes=None, n=80, close_last=100.0):
    """A signal at bar 0 and n flat bars at 100 with ATR 1: target 105, stop 98."""
    rows = []
    for i in range(n + 1):
        row = {"symbol": "a", "bar_i": i, "open_time": T0 + dt.timedelta(minutes=15 * i), "open": 100.0, "high": 100.5, "low": 99.5, "close": 100.0, "volume": 1.0, "atr14": 1.0, "atr_pct": 0.01}
        rows.append(row | (changes or {}).get(i, {}))
    return spark.createDataFrame(pd.DataFrame(rows))


def outcome(spark, exit_, changes=None, n=80, horizon=72, **kw):
    bars = path_frame(spark, changes, n)
    signal = bars.where("bar_i = 0").select("symbol", "bar_i", "close", "atr14", "atr_pct")
    rows = barriers.with_path(signal, bars, horizon, **kw).select(exit_.alias("o")).collect()
    return rows[0].o if rows else None


def test_target_touch_counts(spark):
    o = outcome(spark, barriers.triple_barrier(), {11: {"high": 105.0}})
    assert (o.label, o.outcome, o.exit_offset, o.realized_ret) == (1, "tp", 11, pytest.approx(0.05))


def test_both_in_one_bar_is_the_stop(spark):
    o = outcome(spark, barriers.triple_barrier(), {5: {"high": 106.0, "low": 97.0}})
    assert (o.outcome, o.exit_offset, o.realized_ret) == ("sl_ambiguous", 5, pytest.approx(-0.02))
    assert outcome(spark, barriers.triple_barrier(tie="tp"), {5: {"high": 106.0, "low": 97.0}}).outcome == "tp"


def test_short_tail_and_low_atr_give_no_outcome(spark):
    assert outcome(spark, barriers.triple_barrier(), n=71) is None
    assert outcome(spark, barriers.triple_barrier(), {0: {"atr_pct": 0.001}}) is None


def test_short_side_mirrors(spark):
    assert outcome(spark, barriers.triple_barrier(side="short"), {3: {"low": 95.0}}).realized_ret == pytest.approx(100 / 95 - 1)
    assert outcome(spark, barriers.triple_barrier(side="short"), {3: {"high": 102.0}}).outcome == "sl"


def test_trailing_uses_the_bars_before(spark):
    o = outcome(spark, barriers.trailing(3.0), {2: {"high": 110.0, "low": 106.9}, 3: {"open": 106.0, "low": 105.0}})
    assert (o.outcome, o.exit_offset) == ("trail", 3)
    assert o.realized_ret == pytest.approx(0.06)  # the bar opens below the stop at 107


def scaled_by_hand(bars, first=2.5, multiple=3.0, stop=2.0):
    half, run = False, 100 + first
    for j, (o, h, l, c) in enumerate(bars):
        level = max(run - multiple, 100 - stop) if half else 100 - stop
        if l <= level:
            got = min(level, o) / 100 - 1
            return (0.5 * first / 100 + 0.5 * got if half else got), j + 1, "scaled" if half else "sl"
        if half:
            run = max(run, h)
        elif h >= 100 + first:
            half = True
    got = bars[-1][3] / 100 - 1
    return (0.5 * first / 100 + 0.5 * got if half else got), len(bars), "scaled_timeout" if half else "timeout"


@pytest.mark.parametrize("seed", range(4))
def test_scaled_equals_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    changes, price = {}, 100.0
    for i in range(1, 41):
        o = price
        price += rng.normal(0, 0.8)
        changes[i] = {"open": o, "close": price, "high": max(o, price) + rng.uniform(0, 0.5), "low": min(o, price) - rng.uniform(0, 0.5)}
    changes[1]["open"] = 100.0
    o = outcome(spark, barriers.scaled(), changes, n=60, horizon=40)
    want = scaled_by_hand([(changes[i]["open"], changes[i]["high"], changes[i]["low"], changes[i]["close"]) for i in range(1, 41)])
    assert (o.realized_ret, o.exit_offset, o.outcome) == (pytest.approx(want[0]), want[1], want[2])


def test_breakeven_arms_from_the_next_bar(spark):
    o = outcome(spark, barriers.breakeven(), {2: {"high": 101.5, "low": 99.9}, 3: {"low": 99.0}})
    assert (o.outcome, o.exit_offset, o.realized_ret) == ("be", 3, pytest.approx(0.0))


def test_unknown_names_raise(spark):
    with pytest.raises(KeyError):
        barriers.exit_named("nothing")
    with pytest.raises(ValueError):
        src.width_seconds("7m")
    with pytest.raises(ValueError):
        src.purge_seconds(-1, "15m")
    assert src.purge_seconds(72, "15m") == 73 * 900


@pytest.mark.parametrize("chunk", [7, 64, 8192])
def test_ewm_by_chunks_equals_one_pass(spark, chunk):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"symbol": "a", "bar_i": range(300), "close": 100 + rng.normal(size=300).cumsum()})
    frame = pd.concat([frame, frame.assign(symbol="b", close=frame.close[::-1].to_numpy())])
    got = ewm.with_ewm(spark.createDataFrame(frame), {"m": ("close", ewm.span(21)), "n": ("close", 1 / 14)}, chunk=chunk).toPandas().sort_values(["symbol", "bar_i"])
    for s, own in frame.groupby("symbol"):
        np.testing.assert_allclose(got[got.symbol == s].m, own.close.ewm(span=21, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(got[got.symbol == s].n, own.close.ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-12)


def random_bars(n=260, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 0.5, n).cumsum()
    return pd.DataFrame({"symbol": "a", "bar_i": range(n), "open_time": [T0 + dt.timedelta(hours=i) for i in range(n)], "open": close, "high": close + rng.uniform(0.1, 1, n), "low": close - rng.uniform(0.1, 1, n), "close": close, "volume": rng.uniform(1, 9, n)})


def test_no_column_looks_ahead(spark):
    frame, cut = random_bars(), 200
    later = frame.copy()
    later.loc[later.bar_i > cut, ["open", "high", "low", "close", "volume"]] = 1e6
    make = lambda f: indicators.with_factors(indicators.with_features(indicators.with_indicators(spark.createDataFrame(f)))).where(F.col("bar_i") <= cut).toPandas().sort_values("bar_i").drop(columns=["symbol", "open_time"])
    a, b = make(frame), make(later)
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, equal_nan=True)


def test_rolling_statistics_equal_pandas(spark):
    frame = random_bars(80, 3)
    w = windows.series()
    got = spark.createDataFrame(frame).select("bar_i", windows.rolling_corr("close", "volume", 10, w).alias("c"), windows.rolling_skew("close", 20, w).alias("s"), windows.rolling(F.stddev_samp, "close", 20, w, 5).alias("d")).toPandas().sort_values("bar_i")
    np.testing.assert_allclose(got.c, frame.close.rolling(10).corr(frame.volume), rtol=1e-8)
    np.testing.assert_allclose(got.s, frame.close.rolling(20).skew(), rtol=1e-6)
    np.testing.assert_allclose(got.d, frame.close.rolling(20, min_periods=5).std(), rtol=1e-9)


def greedy_by_hand(rows, gap):
    kept = []
    for i, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(i - j) >= gap for j in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_and_left_gap_equal_loops(spark, seed):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(600, 150, replace=False))
    frame = pd.DataFrame({"symbol": "a", "bar_i": at, "s": rng.integers(0, 20, 150).astype(float)})
    df = spark.createDataFrame(frame)
    assert sorted(r.bar_i for r in selection.greedy_gap(df, "s", 18).collect()) == greedy_by_hand(list(zip(at, frame.s)), 18)
    left, last = [], -99
    for i in at:
        if i - last >= 18:
            left.append(i)
            last = i
    assert sorted(r.bar_i for r in selection.min_gap(df, 18).collect()) == left


def replay_by_hand(frame, slots):
    open_, taken = [], []
    for r in frame.sort_values(["entry_time", "score", "symbol"], ascending=[True, False, True]).itertuples():
        open_ = [p for p in open_ if p[0] > r.entry_time]
        if len(open_) < slots and r.symbol not in {s for _, s in open_}:
            open_.append((r.exit_time, r.symbol))
            taken.append((r.symbol, r.entry_time))
    return sorted(taken)


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    start = rng.integers(0, 400, 200)
    frame = pd.DataFrame({"symbol": [f"s{k}" for k in rng.integers(0, 8, 200)], "score": rng.uniform(size=200).round(6), "entry_time": [T0 + dt.timedelta(hours=int(a)) for a in start], "exit_time": [T0 + dt.timedelta(hours=int(a + b)) for a, b in zip(start, rng.integers(1, 12, 200))]}).drop_duplicates(["symbol", "entry_time"])
    got = sorted((r.symbol, r.entry_time) for r in portfolio.replay(spark.createDataFrame(frame), 0.0, 3).collect())
    assert got == [(s, t.to_pydatetime()) for s, t in replay_by_hand(frame, 3)]


def test_a_slot_is_free_at_its_exit(spark):
    hour = lambda k: T0 + dt.timedelta(hours=k)
    rows = [("a", 1.0, hour(0), hour(2)), ("a", 1.0, hour(1), hour(3)), ("a", 1.0, hour(2), hour(4))]
    got = portfolio.replay(spark.createDataFrame(rows, "symbol string, score double, entry_time timestamp, exit_time timestamp"), 0.5, 10)
    assert sorted(r.entry_time for r in got.collect()) == [hour(0), hour(2)]


def test_range_sum_needs_coverage(spark):
    hour = lambda k: T0 + dt.timedelta(hours=k)
    trades = spark.createDataFrame([("a", 1, hour(0), hour(8)), ("a", 2, hour(8), hour(16)), ("a", 3, hour(12), hour(30)), ("b", 4, hour(0), hour(8))], "k string, i int, s timestamp, e timestamp")
    events = spark.createDataFrame([("a", hour(0), 1.0), ("a", hour(8), 2.0), ("a", hour(16), 4.0)], "k string, t timestamp, v double")
    got = {r.i: r.x for r in joins.range_sum(trades, events, ["k"], "s", "e", "t", "v", "x").collect()}
    assert got == {1: 2.0, 2: 4.0, 3: 4.0, 4: None}  # the history covers the third trade in part, the fourth not at all


def test_asof_without_right_rows_and_with_ties(spark):
    left = spark.createDataFrame([("a", 5), ("b", 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 3)], "k string, u int, v int")
    assert {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()} == {("a", 5): 2, ("b", 5): None, ("a", None): None}
    assert joins.asof_join(left, right, ["k"], "t", "u", ["v"], strict=True).where("v is not null").count() == 0


def test_checked_join_raises(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeats"):
        joins.checked_join(left, right, ["k"]).collect()
    assert joins.checked_join(left, right.where("v = 9"), ["k"], {"v": 0}).first().v == 0


def test_merge_is_idempotent_and_keeps_closed_rows(spark):
    schema = "source string, symbol string, signal_time timestamp, entry double, closed boolean"
    held = spark.createDataFrame([("x", "a", T0, None, False), ("x", "b", T0, 1.0, True)], schema)
    fresh = spark.createDataFrame([("x", "a", T0, 7.0, True), ("x", "b", T0, 9.0, False), ("x", "c", T0, 3.0, False)], schema)
    once = records.merged(held, fresh)
    assert sorted((r.symbol, r.entry, r.closed) for r in once.collect()) == [("a", 7.0, True), ("b", 1.0, True), ("c", 3.0, False)]
    assert sorted(records.merged(once, fresh).collect()) == sorted(once.collect())


def test_stream_gives_the_bars_of_the_batch(spark, tmp_path):
    rows = [(k, "a" if k % 3 else "b", T0 + dt.timedelta(minutes=7 * k), float(k % 11)) for k in range(200)]
    ticks = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = records.stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.symbol, r.open_time): (r.open, r.high, r.low, r.close, r.n) for r in spark.table("bars_out").collect()}
    frame = pd.DataFrame(rows, columns=["i", "s", "t", "v"])
    want = {(s, h.to_pydatetime()): (g.v.iloc[0], g.v.max(), g.v.min(), g.v.iloc[-1], len(g)) for (s, h), g in frame.groupby(["s", frame.t.dt.floor("h")])}
    assert got and all(want[k] == v for k, v in got.items())


def test_csv_series(spark, tmp_path):
    (tmp_path / "okx_BTC_15m_3.csv").write_text("ts,open,high,low,close,volume,vol_ccy,vol_ccy_quote,confirm,open_time\n1700000000000,1,2,0.5,1.5,9,0,0,1,\n1700000900000,1,2,0.5,1.6,9,0,0,0,\n1700001800000,x,2,0.5,1.6,9,0,0,1,\n")
    (tmp_path / "okx_BTC_15m_9.csv").write_text("ts,open,high,low,close,volume,vol_ccy,vol_ccy_quote,confirm,open_time\n1700000000000,1,2,0.5,1.7,9,0,0,1,\n1700002700000,1,2,0.5,1.8,9,0,0,1,\n")
    got = src.read_series(spark, str(tmp_path / "*.csv")).orderBy("bar_i").collect()
    assert [(r.source, r.symbol, r.close, r.bar_i) for r in got] == [("okx", "BTC", 1.7, 0), ("okx", "BTC", 1.8, 1)]


def test_permutation_and_ranking(spark):
    rows = spark.createDataFrame([(k, int(k >= 30), float(k)) for k in range(60)], "i int, y int, s double")
    assert metrics.ranking(rows, "y", "s").first().roc_auc == 1.0
    assert metrics.permutation_pvalue(rows, "y", "s", rounds=99).first().p_value == pytest.approx(0.01)
    assert metrics.ranking(rows.where("false"), "y", "s").first().n == 0


def test_one_exchange_for_the_window_chain(spark):
    frame = spark.createDataFrame(random_bars(30)).withColumn("atr14", F.lit(1.0))
    w = windows.series()
    plan = frame.select("symbol", "bar_i", windows.rolling(F.avg, "close", 5, w).alias("a"), windows.run_length(F.col("close") > 100, w).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
