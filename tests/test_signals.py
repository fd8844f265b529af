"""Signals and the broad bank against loops and pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyframe.functions import broad, indicators
from tallyframe.operators import barriers, signals

T0 = dt.datetime(2024, 1, 1)


def bars(n=300, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 0.2, n).cumsum()
    opens = np.concatenate([[100], close[:-1]])
    return pd.DataFrame({"symbol": "a", "bar_i": range(n), "open_time": [T0 + dt.timedelta(hours=i) for i in range(n)], "open": opens, "high": np.maximum(opens, close) + rng.uniform(0.01, 0.3, n), "low": np.minimum(opens, close) - rng.uniform(0.01, 0.3, n), "close": close, "volume": rng.uniform(1, 9, n)})


def test_broad_bank_equals_pandas(spark):
    f = bars(200)
    got = broad.with_broad(spark.createDataFrame(f)).toPandas().sort_values("bar_i")
    assert len(broad.names()) == 105 and set(broad.names()) <= set(got.columns)
    c, ret = f.close, f.close.pct_change()
    want = {"ret_8": c.pct_change(8), "vol_20": ret.rolling(20).std(), "skew_30": ret.rolling(30).skew(), "cema_10": c / c.ewm(span=10, adjust=False).mean() - 1, "volstd_5": f.volume.rolling(5).std() / f.volume.rolling(5).mean(), "slope_3": (c - c.shift(3)) / (3 * c), "close_tight_8": c.rolling(8).std() / c}
    for name, x in want.items():
        np.testing.assert_allclose(got[name].astype(float), x, rtol=1e-6, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("seed", range(2))
def test_launches_equal_a_state_machine(spark, seed):
    df = signals.with_tips(indicators.with_indicators(spark.createDataFrame(bars(400, seed))), F.col("fast_spread") <= 0.004)
    got = sorted((r.kind, r.arm_i, r.bar_i, r.direction) for r in signals.launches(df, warmup=30).where("kind in ('range', 'volume')").collect())
    f = df.toPandas().sort_values("bar_i").reset_index(drop=True)
    want, arm, fired = [], None, set()
    for i in range(len(f)):
        if f.tip[i] and i >= 30:
            arm, fired = i, set()
        if arm is None or i <= arm or i - arm > 48 or i < 20:
            continue
        top, bottom, mean = f.high[i - 20 : i].max(), f.low[i - 20 : i].min(), f.volume[i - 20 : i].mean()
        side = 1 if f.close[i] > top else -1 if f.close[i] < bottom else 0
        for kind, ok in (("range", True), ("volume", f.volume[i] > 1.5 * mean)):
            if side and ok and kind not in fired:
                fired.add(kind)
                want.append((kind, arm, i, side))
    assert got == sorted(want) and want


def test_straddle_and_oracle(spark):
    f = bars(60, 3).assign(atr14=0.5, atr_pct=0.005)
    df = spark.createDataFrame(f)
    sig = df.where("bar_i = 10").select("symbol", "bar_i", "close", "atr14", "atr_pct").withColumn("range_high", F.col("close") + 0.3).withColumn("range_low", F.col("close") - 0.3)
    o = barriers.with_path(sig, df, 40).select(signals.straddle().alias("s"), signals.oracle_direction().alias("o")).first()
    path = f.iloc[11:51].reset_index(drop=True)
    buy, sell = f.close[10] + 0.35, f.close[10] - 0.35
    hits = [(j, path.high[j] >= buy, path.low[j] <= sell) for j in range(12) if path.high[j] >= buy or path.low[j] <= sell]
    assert o.s.state == ("no_breakout" if not hits else "ambiguous" if hits[0][1] and hits[0][2] else "traded")
    if o.s.state == "traded":
        assert o.s.direction == (1 if hits[0][1] else -1)
    assert o.o.oracle == max(o.o.long, o.o.short)


def test_schedules_fractions_and_form(spark):
    df = spark.createDataFrame(bars(130))
    assert [(r.start_i, r.end_i) for r in signals.window_schedule(df, 50, 30).orderBy("start_i").collect()] == [(0, 49), (30, 79), (60, 109), (80, 129)]
    assert signals.top_fraction(df, "volume", 0.35, ("symbol",)).count() == 46
    assert signals.balanced(df.withColumn("k", (F.col("bar_i") % 10 == 0).cast("int")), "k", 20, 0, 0.5, "bar_i").groupBy("k").count().orderBy("k").collect() == [(0, 13), (1, 13)]
    hour = lambda k: T0 + dt.timedelta(hours=k)
    trades = spark.createDataFrame([("long", k, hour(k), hour(k + 1), 0.1 * (k % 3)) for k in range(30)], "side string, i int, entry_time timestamp, exit_time timestamp, realized_ret double")
    form = {r.i: r.form for r in signals.side_form(trades, 1, 5).collect()}
    assert form[3] is None and form[20] == pytest.approx(np.mean([0.1 * (k % 3) for k in range(20) if k + 1 < 20]))
