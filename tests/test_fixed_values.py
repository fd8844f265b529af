"""Values that must be what the survey's fixtures say, and the edges around them."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyframe.functions import indicators, scalars
from tallyframe.operators import barriers, models, signals
from tallyframe.sources import bars as src


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("ratio, want", [(0.99, 0), (1.0, 1), (1.09, 1), (1.1, 2), (1.24, 2), (1.25, 3), (1.49, 3), (1.5, 4), (1.99, 4), (2.0, 5), (9.0, 5)])
def test_stars_over_a_threshold(spark, ratio, want):
    assert value(spark, scalars.stars(F.lit(ratio), F.lit(1.0))) == want


@pytest.mark.parametrize("score, want", [(0.0149, 0), (0.015, 1), (0.022, 2), (0.028, 3), (0.035, 4), (0.05, 5), (float("nan"), 0), (float("inf"), 0), (None, 0)])
@pytest.mark.parametrize("threshold", [None, 0.0, float("nan")])
def test_stars_without_one(spark, score, want, threshold):
    assert value(spark, scalars.stars(F.lit(score).cast("double"), F.lit(threshold).cast("double"))) == want


@pytest.mark.parametrize("size, lot, least, want", [(0.004, 0.01, 0.01, 0.01), (1.29, 0.1, 0.1, 1.2), (0.3, 0.1, 0.1, 0.3), (5.7, 0.0, 1.0, 5.0), (0.2, -1.0, 1.0, 1.0)])
def test_lots(spark, size, lot, least, want):
    assert value(spark, scalars.lots(F.lit(size), F.lit(lot), F.lit(least))) == pytest.approx(want)


def test_timeframe_votes_and_grades(spark):
    row = {"dense": True, "order_score": 4, "ma_spread_pct": 0.0, "close": 10.0, "ema55": 9.0, "ext_up": 0.0, "atr_pct": 0.01}
    df = spark.createDataFrame([row, row | {"dense": False, "order_score": 0, "ma_spread_pct": 1.0, "close": 8.0, "ext_up": 0.02, "atr_pct": 0.05}])
    got = [r.v for r in df.select(scalars.timeframe_vote(0.0045).alias("v")).collect()]
    assert got == [round((1 + 1 + 1 + 0.85 + 0.8 + 0.75) / 6, 4), round((0.25 + 0 + 0 + 0.25 + 0.2 + 0.35) / 6, 4)]

    def whole(votes, side="volume", rank=1):
        kind = "struct<vote: double, dense: boolean, above: boolean>"
        cols = {k: F.lit(None).cast(kind) if v is None else F.struct(F.lit(v[0]).alias("vote"), F.lit(v[1]).alias("dense"), F.lit(v[2]).alias("above")) for k, v in votes.items()}
        return value(spark, scalars.composite(cols, F.lit(side), F.lit(rank)))

    both = whole({"15m": (0.7, True, True), "30m": (0.6, True, True), "1m": None})
    assert (both.base, both.align, both.grade) == (round((0.35 * 0.7 + 0.3 * 0.6) / 0.65, 4), 0.07, "A")
    assert whole({"15m": (0.9, False, True), "30m": (0.9, False, True)}).grade == "B"
    assert whole({"15m": (0.7, True, True), "30m": None}).grade == "A"
    low = whole({"1m": (0.5, True, True), "3m": (0.5, True, True), "30m": (0.5, False, False)})
    assert low.align == -0.05 and low.grade == "C" and low.composite == 0.45
    assert [whole({"15m": (0.5, False, False)}, s, r).boost for s, r in (("gain", 1), ("gain", 3), ("gain", 9), ("loss", 1), ("loss", 9), ("major", 1))] == [0.06, 0.04, 0.0, -0.02, 0.02, 0.0]


def test_features_are_the_models_inputs_in_order():
    assert len(indicators.FEATURES) == 28 and indicators.FEATURES[0] == "ma_spread_pct" and indicators.FEATURES[-1] == "ret_48"
    assert "zero_volume96" not in indicators.FEATURES and len(set(indicators.FEATURES)) == 28


def audited(spark, rows, now="2024-01-02 00:00:00", symbol="BTC_USDT"):
    df = spark.createDataFrame([(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), *map(float, x)) for m, *x in rows], "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    df = df.withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))  # below 0 stands for missing here
    return src.audit(df, 900, now=F.lit(now)).first()


def test_audit_at_its_edges(spark):
    flat = lambda n, v=1.0: [(15 * k, 1, 1, 1, 1, v) for k in range(n)]
    fine = audited(spark, flat(50))
    assert (fine.reasons, fine.flagged, fine.blacklist_candidate, fine.n_gaps, fine.max_gap_hours, fine.age_hours) == ("", False, False, 0, 0.25, 11.8)
    assert audited(spark, flat(49) + [(15 * 49, 1, 1, 1, 1, 0)]).reasons == ""  # 0.02 exactly
    two = audited(spark, flat(48) + [(15 * 48, 1, 1, 1, 1, 0), (15 * 49, 1, 1, 1, 1, -1)])
    assert (two.zero_vol_share, two.reasons, two.blacklist_candidate) == (0.04, "zero_vol>0.02", False)
    assert audited(spark, flat(48) + [(15 * 48, 1, 1, 1, 1, 0), (15 * 49, 1, 1, 1, 1, 0)], symbol="TSLA_USDT_SWAP").blacklist_candidate
    wick = [(15 * k, x, x, x, x, 1) for k, x in enumerate([1, 2, 1, 1, 1])]
    assert (audited(spark, wick).spike_bars, audited(spark, wick).reasons) == (2, "")
    more = [(15 * k, x, x, x, x, 1) for k, x in enumerate([1, 2, 1, 2, 2])]
    assert audited(spark, more).reasons == "spikes>=3" and not audited(spark, more).blacklist_candidate
    assert audited(spark, [(0, 0, 1, 0, 1, 1)]).reasons == "ohlc_bad" and audited(spark, [(0, 1, 0.5, 1, 1, 1)]).blacklist_candidate
    assert audited(spark, flat(3), "2024-01-03 00:30:00").reasons == "" and audited(spark, flat(3), "2024-01-03 01:00:00").reasons == "stale>48.0h"
    holes = audited(spark, [(60 * k, 1, 1, 1, 1, 1) for k in range(7)])
    assert holes.n_gaps == 6 and holes.reasons == "gaps>5" and holes.blacklist_candidate
    both = src.audit_summary(spark.createDataFrame([("gaps>5", True, True), ("stale>48.0h", True, False), ("", False, False)], "reasons string, flagged boolean, blacklist_candidate boolean")).first()
    assert tuple(both) == (3, 2, 1, 1)


def test_launches_of_a_kind_lie_apart(spark):
    rng = __import__("random").Random(3)
    price, rows = 100.0, []
    for k in range(500):
        price *= 1 + rng.uniform(-0.004, 0.004)
        rows.append(("A", k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), price, price * 1.001, price * 0.999, price * (1 + rng.uniform(-0.001, 0.001)), rng.uniform(1, 5)))
    df = spark.createDataFrame(rows, "symbol string, bar_i long, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    tips = signals.with_tips(indicators.with_indicators(df), F.col("fast_spread") <= 0.004)
    near, far = ([(r.kind, r.bar_i) for r in signals.launches(tips, gap=g).collect()] for g in (1, 18))
    for kind in {k for k, _ in near}:
        kept, last = [], None
        for b in sorted(b for k, b in near if k == kind):
            if last is None or b - last >= 18:
                kept, last = [*kept, b], b
        assert sorted(b for k, b in far if k == kind) == kept
    assert signals.EXPANSION == 0.00383


def test_decaying_stops_and_tertiles(spark):
    path = [(j, 100.0, 100.2, 98.4 if j == 30 else 99.9, 100.0) for j in range(40)]
    bars = spark.createDataFrame([("A", 0, 100.0, 100.0, 100.0, 100.0), *(("A", 1 + j, *x) for j, *x in path)], "symbol string, bar_i long, open double, high double, low double, close double")
    sig = spark.createDataFrame([("A", 0, 1.0, 0.01)], "symbol string, bar_i long, atr14 double, atr_pct double")
    met = barriers.with_path(sig, bars, 40)
    out = met.select(barriers.time_decay().alias("o")).first().o
    assert (out.outcome, out.exit_offset, out.realized_ret) == ("sl_decay", 31, pytest.approx(98.5 / 100 - 1))
    for atr, mult in ((0.004, 4.0), (0.005, 5.0), (0.02, 6.0), (float("nan"), 5.0)):
        up = [("A", 0, 100.0, 100.0, 100.0, 100.0), *(("A", 1 + j, 100.0, 110.0 if j == 5 else 100.1, 99.9, 100.0) for j in range(40))]
        b = spark.createDataFrame(up, "symbol string, bar_i long, open double, high double, low double, close double")
        s = barriers.with_path(spark.createDataFrame([("A", 0, 1.0, 0.01)], "symbol string, bar_i long, atr14 double, atr_pct double"), b, 40).withColumn("atr_pct", F.lit(atr))
        assert s.select(barriers.by_volatility(0.004, 0.008).alias("o")).first().o.realized_ret == pytest.approx(mult / 100)


@pytest.mark.parametrize("n", [10, 37])
def test_split_by_row_position_with_ties(spark, n):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 3)) for k in range(n)]
    got = {r.k: r.split for r in models.time_split(spark.createDataFrame(rows, "k long, t timestamp_ntz").repartition(4), "t", 3600, 0.8, order="k").collect()}
    f = pd.DataFrame(rows, columns=["k", "t"]).sort_values(["t", "k"]).reset_index(drop=True)
    i = int(n * 0.8)
    start = f.t[i]
    want = {r.k: "val" if j >= i else "train" if r.t < start - pd.Timedelta(hours=1) else "purged" for j, r in f.iterrows()}
    assert got == want


def test_position_in_order(spark):
    values = [5, 5, 5, -3, 10**12, 7, None]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [models.at_position(df, "x", k, buckets=4) for k in range(7)] == [*sorted(v for v in values if v is not None), None]
