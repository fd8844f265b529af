"""Every cell of a rule grid against a plain loop over cells, windows and boxes."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyframe.operators import rule_grid

FAST, FULL, LEAST, MOST = (0.3, 0.5, 0.8), (0.4, 0.9), (2, 4), (5, 9)


def windows() -> pd.DataFrame:
    rng = np.random.default_rng(12)
    frames = []
    for k in range(8):
        n = 70
        f = pd.DataFrame({"symbol": f"s{k % 3}", "window": k, "bar_i": range(n), "fast_spread": np.abs(rng.normal(0.4, 0.25, n)), "full_spread": np.abs(rng.normal(0.5, 0.3, n)), "part": "fit" if k < 5 else "hold"})
        f["ema8"], f["ema21"] = 100 + rng.normal(size=n).cumsum(), 100 + rng.normal(size=n).cumsum()
        f.loc[rng.random(n) < 0.03, "fast_spread"] = np.nan
        frames.append(f)
    return pd.concat(frames)


def segments(f: pd.DataFrame, fast: float, full: float, least: int, most: int) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for i in np.flatnonzero((f.fast_spread <= fast) & (f.full_spread <= full)):
        if runs and i - runs[-1][1] <= 4:
            runs[-1][1] = int(i)
        else:
            runs.append([int(i), int(i)])
    out = []
    for s, e in runs:
        if e - s + 1 < least:
            continue
        if e - s + 1 > most:
            means = [f.full_spread.to_numpy()[i : i + most].mean() for i in range(s, e - most + 2)]
            best = s + next(k for k, m in enumerate(means) if m <= min(means) + 1e-12)
            s, e = best, best + most - 1
        out.append((s, e))
    return out


def box(f: pd.DataFrame, s: int, e: int) -> tuple:
    values = f[["ema8", "ema21"]].to_numpy()[s : e + 1]
    low, high = values.min(), values.max()
    pad = (high - low) * 0.25
    return s, e, low - pad, high + pad


def iou(a: tuple, b: tuple) -> float:
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1) * max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
    area = lambda x: (x[1] - x[0] + 1) * (x[3] - x[2])
    return both / (area(a) + area(b) - both)


def test_cells_equal_a_loop(spark):
    frame = windows()
    keys = ["symbol", "window"]
    bars = spark.createDataFrame(frame).withColumn("fast_spread", F.when(~F.isnan("fast_spread"), F.col("fast_spread")))
    found = rule_grid.swept_segments(bars, keys, FAST, FULL, LEAST, MOST)
    plain, truth = {}, {}
    for (s, k), f in frame.groupby(keys):
        for cell in product(FAST, FULL, LEAST, MOST):
            plain[cell, s, k] = segments(f, *cell)
        truth[s, k] = [box(f, max(0, a - 1), min(69, b + 1)) for a, b in segments(f, 0.5, 0.9, 3, 9)]
    got: dict = {}
    for r in found.collect():
        got.setdefault(((r.fast_limit, r.full_limit, r.min_bars, r.max_bars), r.symbol, r.window), []).append((r.start_i, r.end_i))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in plain.items() if v}

    parts = frame[[*keys, "part"]].drop_duplicates()
    named = spark.createDataFrame(parts)
    boxes = rule_grid.boxed(found, bars, keys, ["ema8", "ema21"]).join(named, keys)
    true = spark.createDataFrame([(s, int(k), int(a), int(b), float(x), float(y)) for (s, k), v in truth.items() for a, b, x, y in v], "symbol string, window long, start_i int, end_i int, low double, high double").join(named, keys)
    scores = rule_grid.cell_scores(boxes, true, keys, "part").collect()
    want = {}
    for cell in product(FAST, FULL, LEAST, MOST):
        for part, own in parts.groupby("part"):
            tp = n_found = n_truth = 0
            for s, k in own[keys].itertuples(index=False):
                f = frame[frame.window == k]
                pred, used = [box(f, *x) for x in plain[cell, s, k]], set()
                for t in truth[s, k]:
                    m = next((i for i, p in enumerate(pred) if i not in used and iou(t, p) >= 0.3), None)
                    if m is not None:
                        used.add(m)
                        tp += 1
                n_found, n_truth = n_found + len(pred), n_truth + len(truth[s, k])
            if n_found:
                want[(*cell, part)] = (tp, n_found - tp, n_truth - tp, round(2 * tp / max(n_found + n_truth, 1), 4))
    assert {(r.fast_limit, r.full_limit, r.min_bars, r.max_bars, r.part): (r.tp, r.fp, r.fn, r.f1) for r in scores} == want and len(want) > 40
    best = {r.place: r for r in rule_grid.best_cells(spark.createDataFrame(scores), "part", "fit", 3).where("part = 'fit'").collect()}
    order = sorted((-v[3], k[:4]) for k, v in want.items() if k[4] == "fit")
    assert [(best[k + 1].f1, (best[k + 1].fast_limit, best[k + 1].full_limit, best[k + 1].min_bars, best[k + 1].max_bars)) for k in range(3)] == [(-f, c) for f, c in order[:3]]


def test_an_empty_table(spark):
    bars = spark.createDataFrame([], "symbol string, bar_i int, fast_spread double, full_spread double, ema8 double")
    found = rule_grid.swept_segments(bars, ["symbol"], FAST, FULL, LEAST, MOST)
    assert found.count() == 0 and rule_grid.boxed(found, bars, ["symbol"], ["ema8"]).count() == 0
