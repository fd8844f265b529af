"""Boxes, scalar functions, other sources, and models."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyframe.functions import scalars
from tallyframe.operators import matching, models
from tallyframe.sources import records

T0 = dt.datetime(2024, 1, 1)
BOXES = "image string, id int, cx double, cy double, w double, h double"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_scores_and_sizes(spark):
    f = F.lit
    got = one(
        spark, low=scalars.tier(f(0.1), f(0.2), f(0.5), f(0.9)), edge=scalars.tier(f(0.5), f(0.2), f(0.5), f(0.9)), nan=scalars.tier(f(float("nan")), f(0.2), f(0.5), f(0.9)), star=scalars.stars(f(1.3), f(1.0)), lone=scalars.stars(f(0.03), f(0.0)),
        none=scalars.stars(f(None).cast("double"), f(1.0)), mult=scalars.size_multiplier(f(None).cast("double")), most=scalars.size_multiplier(f(9.0)), lots=scalars.lots(f(1.29), f(0.1), f(0.1)), few=scalars.lots(f(0.04), f(0.1), f(0.1)), tick=scalars.ticks(f(2.5), f(1.0)),
        t=scalars.display_time(f("2024-01-01 20:00:00").cast("timestamp")), price=scalars.barrier_prices(f(100.0), f(1.0), f("short")), bad=scalars.barrier_prices(f(100.0), f(0.0), f("long")),
    )
    assert (got["low"], got["edge"], got["nan"], got["star"], got["lone"], got["none"], got["mult"], got["most"]) == (0, 2, 0, 3, 3, 0, 1.0, 2.0)
    assert math.isclose(got["lots"], 1.2) and got["few"] == 0.1 and got["tick"] == 2.0
    assert got["t"] == "2024-01-02 04:00" and (got["price"].target, got["price"].stop) == (95.0, 102.0) and got["bad"] is None


@pytest.mark.parametrize("m", [5, 7])
def test_hash_split(spark, m):
    names = [f"C{k}_USDT_SWAP" for k in range(50)]
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", scalars.eval_split(F.col("s"), m).alias("k")).collect()
    assert all(r.k == int(hashlib.sha1(r.s.encode()).hexdigest(), 16) % m for r in got)


def test_matching_is_one_to_one(spark):
    truth = spark.createDataFrame([("i", 0, 0.5, 0.5, 0.2, 0.2), ("i", 1, 0.2, 0.2, 0.1, 0.1)], BOXES)
    found = spark.createDataFrame([("i", 0, 0.52, 0.5, 0.2, 0.2, 0.9), ("i", 1, 0.5, 0.5, 0.2, 0.2, 0.4), ("i", 2, 0.9, 0.9, 0.1, 0.1, 0.8)], BOXES + ", confidence double")
    assert [(r.t, r.f) for r in matching.matched(truth, found, 0.3).collect()] == [(0, 1)]
    assert [(r.t, r.f) for r in matching.matched(truth, found, 0.3, best=False).collect()] == [(0, 0)]
    f1 = {r.confidence: (r.tp, r.fp, r.fn) for r in matching.f1(truth, found, [0.3, 0.5, 0.95]).collect()}
    assert f1 == {0.3: (1, 2, 1), 0.5: (1, 1, 1), 0.95: (0, 0, 2)}


def test_label_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.1 0.2\n0 0.25 0.5 0.1 0.2 0.9\nbroken line\n\n")
    boxes = records.read_boxes(spark, str(tmp_path))
    assert [(r.id, r.cx, r.confidence) for r in boxes.orderBy("id").collect()] == [(0, 0.25, 0.9), (1, 0.5, None)]
    assert records.box_lines(boxes).first().text == "0 0.250000 0.500000 0.100000 0.200000\n0 0.500000 0.500000 0.100000 0.200000"


def test_settlements_ledger_and_inventory(spark, tmp_path):
    (tmp_path / "BTC_funding.csv").write_text("funding_time_ms,funding_rate,realized_rate\n1700000000000,0.1,0.2\n1700000100000,0.3,\nx,1,1\n")
    assert [r.rate for r in records.read_settlements(spark, str(tmp_path / "*.csv")).orderBy("time").collect()] == [0.2, 0.3]
    (tmp_path / "l.jsonl").write_text('{"k":"a","t":1,"r":0.1}\nnot json\n{"k":"a","t":2,"r":-0.1}\n{"k":"a","t":3,"r":-0.2}\n{"k":"b","t":1,"r":null}\n')
    ledger = records.read_ledger(spark, str(tmp_path / "l.jsonl"), "k string, t int, r double")
    assert {r.k: r.losses for r in records.consecutive_losses(ledger, ["k"], "t", "r").collect()} == {"a": 2, "b": 0}
    inv = tmp_path / "inv"
    inv.mkdir()
    for name in ("okx_BTC_15m_100.csv", "okx_ETH_15m_50.csv", "okx_BTC_1H_7.part.csv", "notes.md"):
        (inv / name).write_text("x")
    got = {r.bar: (r.n_series, r.n_files, r.n_rows, r.n_parts) for r in records.coverage(spark, str(inv)).collect()}
    assert got == {"15m": (2, 2, 150, 0), "1H": (1, 1, 7, 1)}
    lines = spark.createDataFrame([("2024-01-01 10:00 fires=3 late=1",), ("2024-01-01 12:00 fires=4",), ("none",)], "value string")
    assert {r.name: r.total for r in records.log_counters(lines, r"(\w+)=(\d+)", "2024-01-01 11:00").collect()} == {"fires": 4}


def pool(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2))
    return spark.createDataFrame(pd.DataFrame({"t": [T0 + dt.timedelta(hours=i) for i in range(n)], "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)}))


def test_split_purges_and_models_learn(spark, tmp_path):
    rows = models.time_split(pool(spark), "t", 10 * 3600, holdout="2024-01-16").cache()
    last = rows.where("split = 'train'").agg(F.max("t")).first()[0]
    first = rows.where("split = 'val'").agg(F.min("t")).first()[0]
    assert first - last > dt.timedelta(hours=10) and rows.where("split = 'holdout'").agg(F.min("t")).first()[0] == dt.datetime(2024, 1, 16)
    model = models.train_trees(rows, ["a", "b"], "y", rounds=5, depth=2)
    out = models.scored(model, rows.where("split = 'holdout'"))
    assert out.where("(score > 0.5) = (y = 1)").count() > 0.8 * out.count()
    limit = models.threshold(models.scored(model, rows), "score")
    about = models.freeze(model, str(tmp_path), ["a", "b"], limit, rows)
    again, read = models.thaw(spark, str(tmp_path), ["a", "b"])
    assert read == about and models.scored(again, rows).agg(F.sum("score")).first()[0] == pytest.approx(models.scored(model, rows).agg(F.sum("score")).first()[0])
    with pytest.raises(ValueError):
        models.thaw(spark, str(tmp_path), ["a"])
    best = models.best_stump(rows, ["a", "b"], "y").first()
    assert (best.feature, best.op) == ("a", ">=")


def test_fingerprint_ignores_order(spark):
    rows = pool(spark, 50)
    assert models.fingerprint(rows, ["a", "b"]) == models.fingerprint(rows.orderBy(F.desc("a")), ["a", "b"]) != models.fingerprint(rows.limit(49), ["a", "b"])
