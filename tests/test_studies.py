"""Exact quantiles, armed hits, selection by outcome, rank tests and monthly fits, each against a plain version."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import armed, directional, outcomes, quantiles, rank_tests, rolling

# -- quantiles ---------------------------------------------------------------------------------------------------------

QS = (0.0, 0.001, 0.1, 0.25, 0.5, 0.77, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_quantiles_of_many_groups(spark, monkeypatch, rounds):
    """Few pivots, so that rounds matter; ties of a third of a group, one value, two values, tails, and NULL keys."""
    monkeypatch.setattr(quantiles, "PIVOTS", 5)
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=3000), "tail": np.exp(rng.normal(size=2000) * 8), "ties": np.where(rng.random(1500) < 0.4, 7.0, rng.integers(0, 40, 1500)), "one": np.array([4.5]), "two": np.array([1.0, 2.0]),
        "same": np.full(500, -3.25), "zeros": np.array([0.0, -0.0, 0.0]), "huge": np.array([-1e308, 1e-300, 1e308, 5.0]), None: rng.normal(size=77),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("none", None), ("one", float("nan"))]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), "v", QS, ["k"], rounds=rounds).collect()
    found = {(r.k, r.quantile): (r.value, r.n) for r in got}
    assert len(found) == len(got) == len(groups) * len(QS)
    for k, vs in groups.items():
        for q in QS:
            at = q * (len(vs) - 1)
            low = math.floor(at)
            a, b = np.sort(vs)[[low, min(low + 1, len(vs) - 1)]]
            want = a if a == b else a + (at - low) * (b - a)
            assert found[k, q][1] == len(vs)
            assert found[k, q][0] == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_quantiles_without_groups_or_rows(spark):
    rows = spark.createDataFrame([(k,) for k in range(101)], "v int")
    assert {r.quantile: r.value for r in quantiles.exact_quantiles(rows, "v", [0.1, 0.5]).collect()} == {0.1: 10.0, 0.5: 50.0}
    assert quantiles.exact_quantiles(rows.limit(0), "v", [0.5]).count() == 0
    assert quantiles.quantile_table(rows, "v", {"low": 0.25, "mid": 0.5}).first().asDict() == {"n": 101, "low": 25.0, "mid": 50.0}
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(rows, "v", [1.5])


def test_counts_below(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PIVOTS", 4)
    chance = random.Random(1)
    held = {(k, float(chance.randrange(60))): chance.randrange(1, 9) for k in ("a", None) for _ in range(80)}
    got = quantiles.with_counts_below(spark.createDataFrame([(*k, n) for k, n in held.items()], "k string, x double, n long"), "x", {"n": "below"}, ["k"]).collect()
    assert {(r.k, r.x): r.below for r in got} == {(k, x): sum(n for (j, y), n in held.items() if j == k and y < x) for k, x in held}


# -- arms --------------------------------------------------------------------------------------------------------------


def walk(seed: int, n: int = 300) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"symbol": f"s{seed}", "bar_i": range(n), "arm": rng.random(n) < 0.05, "x": rng.normal(size=n), "side": rng.choice([-1, 1, 0], n), "ok": rng.random(n) < 0.4})


def plain_grid(frame: pd.DataFrame, first: tuple, confirmed: tuple, wait: int) -> set:
    """Bar by bar, with a flag for every threshold that an arm has used."""
    out, since, used = set(), None, {}
    for r in frame.itertuples():
        if r.arm:
            since, used = r.bar_i, {}
            continue
        if since is None or r.bar_i - since > wait:
            continue
        if r.side == 0:
            continue
        for t in first:
            if not used.get(("first", t)) and r.x >= t:
                used["first", t] = True
                if r.side < 0:
                    out.add((r.symbol, "first", t, since, r.bar_i))
        for t in confirmed:
            if not used.get(("confirmed", t)) and r.x >= t and r.side < 0 and r.ok:
                used["confirmed", t] = True
                out.add((r.symbol, "confirmed", t, since, r.bar_i))
    return out


def test_threshold_grids_equal_a_plain_loop(spark):
    first, confirmed = (0.1, 0.5, 1.0, 2.0), (0.1, 1.2)
    frames = [walk(k) for k in range(4)]
    bars = spark.createDataFrame(pd.concat(frames))
    found = armed.threshold_grid(bars, F.col("arm"), F.col("x"), F.nullif(F.col("side"), F.lit(0)), F.col("ok"), first, confirmed, 12)
    want = set().union(*(plain_grid(f, first, confirmed, 12) for f in frames))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50
    counted = armed.counted_grid(found, (1, 20)).collect()
    for c in counted:
        n = 0
        for s in {f.symbol[0] for f in frames}:
            last = -(10**9)
            for at in sorted(w[4] for w in want if w[:3] == (s, c.family, c.threshold)):
                if at - last >= c.gap:
                    n, last = n + 1, at
        assert c.n == n


def test_the_cell_that_is_taken(spark):
    cells = lambda rows: spark.createDataFrame(rows, "family string, threshold double, gap int, n long")
    pick = lambda rows: tuple(armed.picked_config(cells(rows), 10, 20, 15, 18, 0.1).first())
    base = ("a", 0.1, 18, 500)
    assert pick([base, ("a", 0.2, 36, 15), ("a", 0.1, 36, 14), ("a", 0.2, 18, 11), ("a", 0.3, 18, 19)]) == ("a", 0.2, 18, 11, True)
    assert pick([base, ("a", 0.2, 36, 15), ("a", 0.1, 36, 11)]) == ("a", 0.1, 36, 11, True)
    assert pick([base, ("a", 0.2, 36, 12)]) == ("a", 0.2, 36, 12, True)
    assert pick([base, ("a", 0.2, 36, 90), ("a", 0.3, 36, 90)]) == ("a", 0.2, 36, 90, False)


# -- selection by outcome ----------------------------------------------------------------------------------------------


def test_only_signals_that_can_be_taken_keep_their_distance(spark):
    rng = np.random.default_rng(4)
    n, gap, horizon = 400, 18, 12
    close = 100 + rng.normal(0, 0.6, n).cumsum()
    f = pd.DataFrame({"symbol": "a", "bar_i": range(n), "open_time": [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)], "open": close + rng.normal(0, 0.2, n), "high": close + rng.uniform(0.3, 1, n), "low": close - rng.uniform(0.3, 1, n), "close": close})
    f["atr14"] = np.where(rng.random(n) < 0.4, np.nan, 1.0)
    f["atr_pct"] = np.where(rng.random(n) < 0.2, 0.0001, 0.01)
    dense = rng.random(n) < 0.85
    bars = spark.createDataFrame(f.assign(dense=dense))
    tips = directional.dense_tips(bars, F.col("dense"))
    paths = outcomes.with_open_path(tips.select("symbol", "bar_i", "close", "atr14", "atr_pct", "range_high", "range_low"), bars, horizon + directional.BREAK_BARS)
    got = {r.bar_i: r.o.asDict() for r in directional.taken_apart(paths, gap, horizon).withColumn("o", directional.direction_outcomes(horizon, cost=0.001)).collect()}

    def touch(entry, atr, part, sign):
        for b in part.itertuples():
            if (b.high >= entry + 3 * atr) if sign > 0 else (b.low <= entry - 3 * atr):
                return 3 * atr / entry - 0.001
            if (b.low <= entry - atr) if sign > 0 else (b.high >= entry + atr):
                return -atr / entry - 0.001
        last = part.close.iloc[-1]
        return (last / entry - 1 if sign > 0 else entry / last - 1) - 0.001

    want, run, last = {}, 0, -(10**9)
    for i in range(n):
        run = run + 1 if dense[i] else 0
        if run != 5 or i - last < gap:
            continue
        part = f.iloc[i + 1 : i + 1 + horizon]
        if not f.atr14[i] > 0 or f.atr_pct[i] < 0.0015 or len(part) < 8:
            continue
        last = i
        entry, atr, high, low = part.open.iloc[0], f.atr14[i], f.high[max(0, i - 19) : i + 1].max(), f.low[max(0, i - 19) : i + 1].min()
        out = {"long": touch(entry, atr, part, 1), "short": touch(entry, atr, part, -1), "breakout": None}
        for j in range(i + 1, min(i + 7, n)):
            if f.close[j] > high or f.close[j] < low:
                rest = f.iloc[j + 1 : j + 1 + horizon]
                if len(rest) >= 4:
                    out["breakout"] = touch(rest.open.iloc[0], atr, rest, 1 if f.close[j] > high else -1)
                break
        want[i] = out | {"oracle": max(out["long"], out["short"])}
    assert set(got) == set(want) and len(want) > 5
    for i, o in want.items():
        assert got[i] == {k: None if v is None else pytest.approx(v, rel=1e-9) for k, v in o.items()}
    assert any(o["breakout"] is not None for o in want.values())


# -- rank tests --------------------------------------------------------------------------------------------------------


def test_the_tail_of_the_normal_distribution(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 1.999999, 2.0, 2.5, 3.0, 5.0, 8.0, 20.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", rank_tests.erfc(F.col("x"))).collect():
        assert r.p == pytest.approx(math.erfc(r.x), rel=1e-11)


def test_rank_sums_of_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PIVOTS", 4)
    chance = random.Random(2)
    rows = [(g, int(chance.random() < 0.3), float(chance.randrange(30)) + (g == "b") * 0.5) for g in ("a", "b", None) for _ in range(120)]
    rows += [("same", k % 2, 1.0) for k in range(6)] + [("lone", 1, 1.0), ("lone", 1, 2.0), ("a", None, 1.0), ("a", 1, None), ("a", 0, float("nan")), ("a", 2, 5.0)]
    got = {r.g: r for r in rank_tests.mann_whitney(spark.createDataFrame(rows, "g string, y int, x double"), "y", "x", ["g"]).collect()}
    assert set(got) == {"a", "b", None, "same", "lone"}
    for g in ("a", "b", None):
        pos, neg = ([x for h, y, x in rows if h == g and y == k and x is not None and x == x] for k in (1, 0))
        u = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        both, n, pairs = pos + neg, len(pos) + len(neg), len(pos) * len(neg)
        ties = sum(c**3 - c for c in pd.Series(both).value_counts())
        z = (max(u, pairs - u) - pairs / 2 - 0.5) / math.sqrt(pairs / 12 * (n + 1 - ties / (n * (n - 1))))
        r = got[g]
        assert (r.n_pos, r.n_neg, r.u) == (len(pos), len(neg), u)
        assert (r.median_pos, r.median_neg) == (np.median(pos), np.median(neg))
        assert r.rank_biserial == pytest.approx(2 * u / pairs - 1, abs=1e-12) and r.z == pytest.approx(z, abs=1e-12)
        assert r.p_value == pytest.approx(min(1.0, math.erfc(max(z, 0) / math.sqrt(2))), rel=1e-9)
    assert got["same"].z is None and got["same"].p_value == 1.0 and got["same"].rank_biserial == 0.0
    assert got["lone"].u is None and got["lone"].p_value is None and got["lone"].n_neg == 0
    assert rank_tests.mann_whitney(spark.createDataFrame(rows, "g string, y int, x double").limit(0), "y", "x").count() == 0


# -- monthly fits ------------------------------------------------------------------------------------------------------


def trades(n: int = 900) -> pd.DataFrame:
    rng = np.random.default_rng(6)
    begun = pd.Timestamp("2023-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 300 * 24, n)), unit="h")
    x = rng.normal(size=(n, 3))
    net = 0.3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=n)
    return pd.DataFrame({"id": range(n), "begun": begun, "ended": begun + pd.to_timedelta(rng.integers(1, 60 * 24, n), unit="h"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "net": net, "size": rng.choice(["l", "s"], n)})


def test_monthly_fits_use_only_what_had_closed(spark):
    frame = trades()
    sets = {"all": ["a", "b", "c"], "two": ["c", "a"], "none": []}
    fits = rolling.monthly_fits(spark.createDataFrame(frame), ["a", "b", "c"], "net", "begun", "ended", sets, F.col("size"), ridge=2.0, least=40).collect()
    seen = set()
    for r in fits:
        month = pd.Timestamp(r.month)
        own = frame[(frame["size"] == r.tier) & (frame.ended < month)]
        assert r.last_closed == own.ended.max() < month and r.n_train == len(own) >= 40
        cols = sets[r.variant]
        want = np.zeros(4)
        want[0] = own.net.mean()
        if cols:
            x = own[cols] - own[cols].mean()
            w = np.linalg.solve(x.T @ x + 2.0 * np.eye(len(cols)), x.T @ (own.net - own.net.mean()))
            for c, v in zip(cols, w, strict=True):
                want[1 + ["a", "b", "c"].index(c)] = v
            want[0] -= (own[cols].mean() * w).sum()
        np.testing.assert_allclose(r.weights, want, atol=1e-9)
        seen.add((r.tier, r.month, r.variant))
    months = {(t, m.date().replace(day=1)) for t, m in zip(frame["size"], frame.begun, strict=True) if ((frame["size"] == t) & (frame.ended < pd.Timestamp(m.date().replace(day=1)))).sum() >= 40}
    assert seen == {(t, m, v) for t, m in months for v in sets}


def test_what_closes_later_changes_nothing(spark):
    frame = trades(400)
    cut = pd.Timestamp("2023-06-01")
    later = frame.copy()
    later.loc[later.ended >= cut, "net"] = 1e6
    weights = lambda f: {(r.month, r.variant): r.weights for r in rolling.monthly_fits(spark.createDataFrame(f), ["a"], "net", "begun", "ended", least=10).collect()}
    one, two = weights(frame), weights(later)
    assert any(one[k] != two[k] for k in one) and all(one[k] == two[k] for k in one if pd.Timestamp(k[0]) <= cut) and any(pd.Timestamp(k[0]) <= cut for k in one)


def test_monthly_metrics_equal_plain_ones(spark):
    frame = trades()
    rows = spark.createDataFrame(frame)
    fits = rolling.monthly_fits(rows, ["a", "b"], "net", "begun", "ended", least=100)
    scored = rolling.monthly_scores(rows, fits, ["a", "b"], "begun")
    got = {(r.variant, r.month): r for r in rolling.monthly_metrics(scored, "net", ["id"]).collect()}
    flat = scored.toPandas()
    factor = lambda x: round(x[x > 0].sum() / -x[x < 0].sum(), 3) if (x < 0).any() else None
    for key, own in flat.groupby(["variant", "month"]):
        if len(own) < 25:
            assert key not in got
            continue
        net = own.sort_values(["score", "id"], ascending=[False, True]).net.to_numpy()
        ten, fifth = max(int(len(net) * 0.1), 1), max(int(len(net) * 0.2), 1)
        r = got.pop(key)
        assert (r.n_test, r.top10_n, r.pf, r.top10_pf, r.top20_pf) == (len(net), ten, factor(net), factor(net[:ten]), factor(net[:fifth]))
        assert r.top20_bps == pytest.approx(net[:fifth].mean() * 1e4, abs=0.06)
    assert not got
