"""Readers of mixed layouts, means over gaps, coverage and null keys."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tallyframe.functions import ewm
from tallyframe.operators import joins
from tallyframe.sources import bars as src

T0 = dt.datetime(2024, 1, 1)
OKX = "ts,open,high,low,close,volume,vol_ccy,vol_ccy_quote,confirm,open_time\n"
GATE = "open_time,open,high,low,close,volume\n"


def okx(k: int, close: float, confirm: int = 1, volume: float = 9) -> str:
    t = T0 + dt.timedelta(minutes=15 * k)
    return f"{int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)},1,2,0.5,{close},{volume},0,0,{confirm},{t}+00:00\n"


def gate(k: int, close: float, volume: float = 9) -> str:
    return f"{T0 + dt.timedelta(minutes=15 * k)}+00:00,1,2,0.5,{close},{volume}\n"


def closes(rows) -> dict:
    out: dict = {}
    for r in rows.orderBy("source", "symbol", "bar", "bar_i").collect():
        out.setdefault((r.source, r.symbol, r.bar), []).append(((r.open_time - T0).total_seconds() / 900, r.close))
    return out


def test_both_layouts_in_one_folder(spark, tmp_path):
    (tmp_path / "okx_A_USDT_15m_2.csv").write_text(OKX + okx(0, 1.1) + okx(1, 1.2, confirm=0) + okx(2, 1.3))
    (tmp_path / "gate_A_USDT_15m_2.csv").write_text(GATE + gate(0, 2.1) + gate(1, 2.2))
    (tmp_path / "B_USDT_1H_2_latest.csv").write_text(GATE + gate(0, 3.1))
    (tmp_path / "odd name.csv").write_text(GATE + gate(0, 4.1))
    (tmp_path / "okx_C_USDT_7m_2.csv").write_text(GATE + gate(0, 4.2))
    (tmp_path / "okx_USDC_USDT_15m_2.csv").write_text(GATE + gate(0, 4.3))
    (tmp_path / "okx_D_USDT_15m_2.csv").write_text("time,price\n1,2\n")
    (tmp_path / "okx_E_USDT_15m_0.csv").write_text("")
    got = closes(src.read_series(spark, str(tmp_path / "*.csv")))
    assert got == {("okx", "A_USDT", "15m"): [(0, 1.1), (2, 1.3)], ("gate", "A_USDT", "15m"): [(0, 2.1), (1, 2.2)], ("okx", "B_USDT", "1H"): [(0, 3.1)]}
    assert ("okx", "USDC_USDT", "15m") in closes(src.read_series(spark, str(tmp_path / "*.csv"), blocked=None))
    table = spark.createDataFrame([("A",)], "base string")
    assert set(closes(src.read_series(spark, str(tmp_path / "*.csv"), blocked=table))) == {("okx", "B_USDT", "1H"), ("okx", "USDC_USDT", "15m")}


def test_gate_files_alone(spark, tmp_path):
    (tmp_path / "gate_A_15m_2.csv").write_text(GATE + gate(1, 2.2) + gate(0, 2.1) + "x,1,2,0.5,1,9\n" + gate(2, "oops"))
    assert closes(src.read_series(spark, str(tmp_path / "*.csv"))) == {("gate", "A", "15m"): [(0, 2.1), (1, 2.2)]}


def test_the_last_row_and_the_last_file_stay(spark, tmp_path):
    (tmp_path / "okx_A_15m_1.csv").write_text(OKX + okx(0, 1.1, volume=99) + okx(1, 1.2, volume=99) + okx(1, 1.0, volume=1))
    (tmp_path / "okx_A_15m_2.csv").write_text(GATE + gate(0, 2.5, volume=1))
    assert closes(src.read_series(spark, str(tmp_path / "*.csv"))) == {("okx", "A", "15m"): [(0, 2.5), (1, 1.0)]}


def test_lines_keep_their_order_over_many_splits(spark, tmp_path):
    body = "".join(gate(k % 50, float(k)) for k in range(5000))
    (tmp_path / "okx_A_15m_1.csv").write_text(GATE + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = closes(src.read_series(spark, str(tmp_path / "*.csv")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("okx", "A", "15m"): [(k, 4950.0 + k) for k in range(50)]}


def test_series_and_their_longest_files(spark, tmp_path):
    for name in ("okx_A_USDT_15m_5.csv", "okx_A_USDT_15m_40_latest.csv", "A_USDT_15m_7.csv", "gate_A_USDT_15m_9.csv", "okx_A_USDT_1H_3.csv", "okx_XAU_USDT_15m_3.csv", "notes.csv"):
        (tmp_path / name).write_text("x")
    got = {(r.source, r.symbol): ([f.rsplit("/", 1)[1] for f in r.files], r.longest.rsplit("/", 1)[1]) for r in src.list_series(spark, str(tmp_path / "*.csv"), "15m").collect()}
    files = ["A_USDT_15m_7.csv", "okx_A_USDT_15m_40_latest.csv", "okx_A_USDT_15m_5.csv"]
    assert got == {("okx", "A_USDT"): (files, files[1]), ("gate", "A_USDT"): (["gate_A_USDT_15m_9.csv"], "gate_A_USDT_15m_9.csv")}
    with pytest.raises(ValueError):
        src.list_series(spark, str(tmp_path), "2m")


def test_candles_by_milliseconds(spark, tmp_path):
    (tmp_path / "a.csv").write_text(OKX + okx(0, 1.1, confirm=0) + okx(1, "x") + okx(0, 1.2))
    assert [(r.open_time, r.close) for r in src.read_candles(spark, str(tmp_path / "a.csv")).orderBy("close").collect()] == [(T0, 1.1), (T0, 1.2)]


@pytest.mark.parametrize("chunk", [10, 16, 60, 8192])
@pytest.mark.parametrize("gaps", ["some", "edges", "long", "head", "all"])
def test_means_over_missing_values(spark, chunk, gaps):
    rng = np.random.default_rng(5)
    close = 100 + rng.normal(size=60).cumsum()
    missing = {"some": rng.random(60) < 0.4, "edges": np.isin(np.arange(60), [8, 9, 10, 11, 19, 20, 30, 39]), "long": (np.arange(60) > 12) & (np.arange(60) < 47), "head": np.arange(60) < 23, "all": np.ones(60, bool)}[gaps]
    frame = pd.DataFrame({"symbol": "a", "bar_i": range(60), "close": np.where(missing, np.nan, close), "whole": close})
    given = spark.createDataFrame([(r.symbol, r.bar_i, None if np.isnan(r.close) else r.close, r.whole) for r in frame.itertuples()], "symbol string, bar_i long, close double, whole double")
    got = ewm.with_ewm(given, {"m": ("close", ewm.span(5)), "n": ("whole", ewm.span(30))}, chunk=chunk).toPandas().sort_values("bar_i")
    np.testing.assert_allclose(got.m.astype(float), frame.close.ewm(span=5, adjust=False).mean(), rtol=1e-12)
    np.testing.assert_allclose(got.n.astype(float), frame.whole.ewm(span=30, adjust=False).mean(), rtol=1e-12)


def test_sums_where_the_history_lies_outside(spark):
    hour = lambda k: T0 + dt.timedelta(hours=k)
    events = spark.createDataFrame([("a", hour(10), 1.0), ("a", hour(20), 2.0)], "k string, t timestamp, v double")
    spans = {1: (0, 9), 2: (0, 10), 3: (20, 30), 4: (21, 30), 5: (10, 20), 6: (0, 40), 7: (12, 13)}
    trades = spark.createDataFrame([("a", i, hour(a), hour(z)) for i, (a, z) in spans.items()], "k string, i int, s timestamp, e timestamp")
    got = {r.i: r.x for r in joins.range_sum(trades, events, ["k"], "s", "e", "t", "v", "x").collect()}
    assert got == {1: None, 2: 1.0, 3: 0.0, 4: None, 5: 2.0, 6: 3.0, 7: 0.0}


def test_null_keys_meet_nothing_and_far_times_are_no_burden(spark):
    left = spark.createDataFrame([("a", 5), (None, 5), ("a", 10**15), (None, None)], "k string, t long")
    right = spark.createDataFrame([("a", 4, 1), (None, 4, 2), (None, 10**15, 4), ("a", -(10**17), 3)], "k string, u long, v int")
    got = joins.asof_join(left, right, ["k"], "t", "u", ["v"], stretch=10).collect()
    assert {(r.k, r.t): r.v for r in got} == {("a", 5): 1, (None, 5): None, ("a", 10**15): 1, (None, None): None}
    far = joins.asof_join(spark.createDataFrame([("a", 0)], "k string, t long"), right, ["k"], "t", "u", ["v"], stretch=10)
    assert far.first().v == 3
