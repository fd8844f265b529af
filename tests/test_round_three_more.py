"""The log by days, ranking by ranges, disagreement of boxes, ranked pools and result files, against plain versions."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import matching, metrics, pool, quantiles
from tallyframe.sources import records as src
from tallyframe.streaming import records

T0 = dt.datetime(2024, 1, 1)
LOG = "source string, symbol string, signal_time timestamp, entry double, closed boolean"


def test_a_batch_writes_only_the_days_it_touches(spark, tmp_path):
    path = str(tmp_path / "log")
    put = records.into_log(path)
    day = lambda k: T0 + dt.timedelta(days=k)
    batches = [
        [("x", "a", day(0), None, False), ("x", "b", day(0), 1.0, True), ("x", "a", day(1), 2.0, False)], [("x", "a", day(0), 7.0, True), ("x", "b", day(0), 9.0, False)], [], [("x", "c", None, 3.0, False), ("x", "a", day(1), 5.0, True)],
    ]
    held = None
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, LOG)
        put(batch, k)
        put(batch, k)  # runs again after a failure
        held = batch if held is None else records.merged(held, batch)
        got = records.read_log(spark, path).select(batch.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, held.collect()))
    days = lambda k: sorted(os.path.basename(p) for p in glob.glob(f"{path}/version={k}/day=*"))
    assert [days(k) for k in range(4)] == [["day=d20240101", "day=d20240102"], ["day=d20240101"], [], ["day=d20240102", "day=dnone"]]
    assert records.read_log(spark, str(tmp_path / "nothing")) is None


def test_a_stream_into_the_log(spark, tmp_path):
    rows = [("x", f"s{k % 5}", T0 + dt.timedelta(hours=k % 60), float(k), k > 150) for k in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], LOG).dropDuplicates(["source", "symbol", "signal_time"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = source.writeStream.foreachBatch(records.into_log(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    keys = {(s, t) for _, s, t, _, _ in rows}
    got = records.read_log(spark, str(tmp_path / "log")).collect()
    assert {(r.symbol, r.signal_time) for r in got} == keys and len(got) == len(keys)


def test_ranking_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PIVOTS", 4)
    chance = random.Random(3)
    rows = [(int(chance.random() < 0.3), round(chance.random(), 2)) for _ in range(500)] + [(None, 1.0), (1, None)]
    r = metrics.ranking(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = ([s for y, s in rows if y == k and s is not None] for k in (1, 0))
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    whole = [x for x in rows if None not in x]
    steps = sum(sum(y for y, s in whole if s == t) * sum(y for y, s in whole if s >= t) / sum(s >= t for _, s in whole) for t in {s for _, s in whole}) / len(pos)
    assert (r.n, r.roc_auc, r.average_precision) == (500, pytest.approx(auc, abs=1e-6), pytest.approx(steps, abs=1e-6))


def test_what_owners_made_of_boxes(spark):
    chance = random.Random(8)
    box = lambda: (chance.random(), chance.random(), chance.choice([0.2, 0.3]), 0.3)
    rules = [(k % 12, k, *box()) for k in range(60)]
    owners = [(i, 100 + k, cx + chance.choice([0, 0.01, 0.05, 0.2]), cy, w * chance.choice([1, 1, 1.5]), h) for k, (i, _, cx, cy, w, h) in enumerate(rules) if k % 5] + [(20, 900, *box())]
    schema = "image int, id int, cx double, cy double, w double, h double"

    def iou(a, b):
        x = max(0, min(a[2] + a[4] / 2, b[2] + b[4] / 2) - max(a[2] - a[4] / 2, b[2] - b[4] / 2)) * max(0, min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2))
        return x / (a[4] * a[5] + b[4] * b[5] - x)

    want, taken, wider, shift = {}, set(), [], []
    for r in rules:
        free = [(iou(r, o), -o[1], o) for o in owners if o[0] == r[0] and o[1] not in taken]
        best = max(free, default=None)
        if best and best[0] >= 0.3:
            taken.add(best[2][1])
            want[r[1]] = (best[2][1], "accepted" if best[0] >= 0.8 else "reshaped")
            if best[0] < 0.8:
                wider.append(best[2][4] / r[4])
                shift.append(best[2][2] - r[2])
        else:
            want[r[1]] = (None, "deleted")
    each, totals = matching.disagreement(spark.createDataFrame(rules, schema), spark.createDataFrame(owners, schema))
    got = each.collect()
    assert {x.r: (x.o, x.verdict) for x in got if x.r is not None} == want
    assert {x.o for x in got if x.r is None} == {o[1] for o in owners} - taken and all(x.verdict == "added" for x in got if x.r is None)
    t = totals.first()
    assert (t.rule_boxes, t.owner_boxes, t.reshaped, t.added) == (60, len(owners), len(wider), len(owners) - len(taken)) and t.reshaped > 3 and t.deleted > 3
    assert t.median_width_ratio == round(sorted(wider)[len(wider) // 2], 3) and t.mean_x_shift == pytest.approx(sum(shift) / len(shift), abs=6e-5)
    none = matching.disagreement(spark.createDataFrame([], schema), spark.createDataFrame([], schema))[1].first()
    assert (none.rule_boxes, none.accept_rate, none.median_width_ratio) == (0, 0.0, None)


@pytest.mark.parametrize("most", [None, 1, 4, 9, 50])
def test_the_pool_is_filled_in_order(spark, most):
    chance = random.Random(5)
    tickers = [(f"s{k}", chance.uniform(-9, 9), float(chance.randrange(1000))) for k in range(60)]
    pinned = ("s5", "s50", "gone", "s7")
    out, seen = [], set()

    def put(side, ranked):
        for k, t in ranked:
            if t[0] not in seen:
                seen.add(t[0])
                out.append((t[0], side, k))

    by = {t[0]: t for t in tickers}
    put("major", [(k + 1, by[s]) for k, s in enumerate(pinned) if s in by])
    put("volume", list(enumerate(sorted((t for t in tickers if t[0] not in pinned), key=lambda t: (-t[2], t[0]))[:6], 1)))
    liquid = [t for t in tickers if t[2] >= 300]
    put("gain", list(enumerate(sorted(liquid, key=lambda t: (-t[1], t[0]))[:5], 1)))
    put("loss", list(enumerate(sorted(liquid, key=lambda t: (t[1], t[0]))[:5], 1)))
    frame = spark.createDataFrame([*tickers, (None, 1.0, 1.0), ("odd", None, 9e9)], "symbol string, change double, volume double")
    got = pool.scan_pool(frame, pinned, 6, 5, 300.0, most=most).collect()
    assert {(r.symbol, r.side, r.rank) for r in got} == set(out if most is None else out[:most])


def test_result_files_of_all_shapes(spark):
    files = {
        "list": [{"a": 1, "b": "x"}, 5, None, {"c": {"d": [1]}}], "empty": [], "runs": {"name": "n", "a": 1, "skip": [1], "results": [], "runs": [{"a": 2}, "s", {"b": None}]}, "one": {"a": True, "results": {"x": 1}, "b": [1, 2]}, "scalar": 7, "text": "t",
        "first": {"items": [{"k": 1}], "results": [{"k": 2}]},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in files.items()] + [("broken", "{no"), ("null", None)], "id string, text string")
    got: dict = {}
    for r in src.flattened(frame, "text", "id").collect():
        got.setdefault(r.id, {})[r.row_index, r.name] = r.value
    assert got == {
        "list": {(0, "a"): "1", (0, "b"): "x", (1, "value"): "5", (2, "value"): None, (3, "c"): '{"d":[1]}'}, "empty": {(None, "_empty"): "true"},
        "runs": {(0, "a"): "2", (0, "name"): "n", (1, "a"): "1", (1, "name"): "n", (1, "value"): "s", (2, "a"): "1", (2, "b"): None, (2, "name"): "n"},
        "one": {(None, "a"): "true", (None, "results"): '{"x":1}', (None, "b"): "[1,2]"}, "scalar": {(None, "value"): "7"}, "text": {(None, "value"): "t"}, "first": {(0, "k"): "2"},
    }
    assert src.flattened(frame.where(F.lit(False)), "text", "id").count() == 0
