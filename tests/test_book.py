"""The live book: the stream gives the actions of the batch, also after a restart, and both those of a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyframe.streaming.book import EVENT, Rules, book_actions, live_book

T0 = dt.datetime(2024, 1, 1)
RULES = Rules(slots=2, hours=18, losses=2, minutes=30)
H = lambda h: T0 + dt.timedelta(hours=h)


def events(seed: int, n: int = 400) -> list[tuple]:
    chance = random.Random(seed)
    out, keys = [], [("k", T0, "a")]
    for k in range(n):
        ts = T0 + dt.timedelta(seconds=chance.randrange(0, 10 * 86_400), microseconds=chance.randrange(10**6))
        book = chance.choice(["a", "a", "a", "b"])
        if chance.random() < 0.6:
            if chance.random() < 0.7:
                keys.append((f"k{k}", ts - dt.timedelta(minutes=chance.randrange(40)), book))
            else:  # a signal that is there already, met again some minutes later
                ts, book = keys[-1][1] + dt.timedelta(minutes=chance.randrange(60)), keys[-1][2]
            out.append((book, ts, k, "signal", *keys[-1][:2], chance.choice([ts, ts, None]), None))
        else:
            key, at, book = chance.choice(keys[-8:])
            out.append((book, at + dt.timedelta(hours=chance.randrange(1, 20)), k, "close", key, None, None, chance.choice([0.1, -0.1, -0.1, -0.1, None])))
    return sorted(out, key=lambda e: (e[1], e[2]))


def plain(rows: list[tuple], rules: Rules, until: dt.datetime) -> list[tuple]:
    """One position after another, all state in plain lists, by the minute of every event."""
    out = []
    for book in sorted({r[0] for r in rows}):
        open_, taken, losses = [], set(), 0
        own = sorted((r for r in rows if r[0] == book), key=lambda r: (r[1], r[2]))
        for _, ts, number, kind, key, signalled, entered, net in [*own, (book, until, -1, "end", *[None] * 4)]:
            for k, e in sorted((p for p in open_ if p[1] is not None), key=lambda p: (p[1], p[0])):
                if e + dt.timedelta(hours=rules.hours) <= ts:
                    open_.remove((k, e))
                    out.append((book, e + dt.timedelta(hours=rules.hours), None, "timeout_close", k, len(open_), losses))
            if kind == "signal":
                if ts - signalled > dt.timedelta(minutes=rules.minutes):
                    what = "stale"
                elif key in taken:
                    what = "taken"
                elif losses >= rules.losses:
                    what = "paused"
                elif len(open_) == rules.slots:
                    what = "full"
                else:
                    what = "opened"
                    open_.append((key, entered))
                    taken.add(key)
            elif kind == "close":
                held = [p for p in open_ if p[0] == key]
                what = "closed" if held else "unknown"
                if held:
                    open_.remove(held[0])
                    losses = losses + 1 if net is not None and net < 0 else 0
            else:
                continue
            out.append((book, ts, number, what, key, len(open_), losses))
    return sorted(out, key=str)


def got(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_the_fold_equals_a_plain_loop(spark, seed):
    rows = events(seed)
    table = spark.createDataFrame(rows, f"who string, {EVENT}").repartition(3)
    have = got(book_actions(table, "who", RULES, H(24 * 12)))
    assert have == plain(rows, RULES, H(24 * 12))
    assert {r[3] for r in have} == {"opened", "closed", "timeout_close", "taken", "stale", "full", "paused", "unknown"}


def test_unknown_ages_and_odd_rows(spark):
    rows = [
        (None, H(0), 1, "signal", "x", H(0), None, None), (None, H(99), 2, "close", "x", None, None, -0.5), (None, H(100), 3, "signal", None, H(100), H(100), None),
        ("a", None, 4, "signal", "y", H(0), H(0), None), ("a", H(0), 5, "signal", "z", H(0), H(0), None), ("a", H(18), 6, "signal", "w", H(18), H(18), None), ("a", H(19), 7, "tick", None, None, None, None),
    ]
    have = got(book_actions(spark.createDataFrame(rows, f"who string, {EVENT}"), "who", Rules()))
    assert [(r[0], r[3], r[4], r[5]) for r in sorted(have, key=lambda r: (r[0] or "", r[1], r[2] or 0))] == [
        (None, "opened", "x", 1), (None, "closed", "x", 0), (None, "stale", None, 0), ("a", "opened", "z", 1), ("a", "timeout_close", "z", 0), ("a", "opened", "w", 1),
    ]
    assert book_actions(spark.createDataFrame([], f"who string, {EVENT}"), "who").count() == 0


def test_the_stream_equals_the_batch_also_after_a_restart(spark, tmp_path):
    """Out of order within the watermark, four files, stopped and started again after two of them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, end = events(7, 160), H(24 * 11)
    rows.append(("zz", end + dt.timedelta(hours=1), 9999, "tick", None, None, None, None))
    schema = f"who string, {EVENT}"
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    chance = random.Random(1)

    def run(part: list[tuple], number: int) -> None:
        late = sorted(part, key=lambda r: r[1] + dt.timedelta(minutes=chance.randrange(50)))
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(inbox / f"p={number}"))

    def stream() -> None:
        source = spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1).parquet(str(inbox))
        q = live_book(source, "who", RULES, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    cut = [0, 50, 90, 130, len(rows)]
    for k in range(2):
        run(rows[cut[k] : cut[k + 1]], k)
    stream()
    first = len(spark.read.parquet(out).collect())
    for k in range(2, 4):
        run(rows[cut[k] : cut[k + 1]], k)
    stream()
    have = got(spark.read.parquet(out).select("book", "at", "event_id", "action", "signal_key", "n_open", "losses"))
    assert 0 < first < len(have)
    assert have == plain(rows[:-1], RULES, end)
    assert have == got(book_actions(spark.createDataFrame(rows, schema), "who", RULES, end))
