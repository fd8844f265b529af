"""The live book: positions that signals open and closes, time-outs and a circuit breaker end, as a keyed fold of events.

One fold, two ways to run it. Over a table it streams through each book's events in order. Over a stream it is a stateful
processor: events wait until the watermark has passed them, are folded in order, and timers close what has been held too
long. Both give the same actions for all events and time-outs that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event needs beside its book: a number that orders events of one time, the kind (signal or close), the key of the
#: signal, when the signal was, when its order was filled, and the net return of a close.
EVENT = "ts timestamp, event_id long, kind string, signal_key string, signal_time timestamp, entry_time timestamp, net_ret double"
ACTION = "at timestamp, event_id long, action string, signal_key string, n_open int, losses int"


@dataclass(frozen=True)
class Rules:
    """Positions at once, hours after which one is closed, losses in a row that stop new ones, and minutes after which a signal
    is too old to open one."""

    slots: int = 1
    hours: float = 18.0
    losses: int = 5
    minutes: float = 30.0

    @property
    def held_us(self) -> int:
        return round(self.hours * 3_600_000_000)

    @property
    def fresh_us(self) -> int:
        return round(self.minutes * 60_000_000)


@dataclass
class Book:
    """The state of one book. ``open`` maps a signal's key to the microsecond at which it must close, or None where its entry
    isn't known: of unknown age, it never times out. ``taken`` maps the keys that opened to their signals' times, of which a
    key has one; those too old to open again are forgotten."""

    rules: Rules
    open: dict[str, int | None] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)
    losses: int = 0

    def expire(self, now: int) -> Iterator[tuple]:
        """Closes what must close by ``now``, from early to late."""
        for due, key in sorted((due, key) for key, due in self.open.items() if due is not None and due <= now):
            del self.open[key]
            yield due, None, "timeout_close", key, len(self.open), self.losses
        self.taken = {k: t for k, t in self.taken.items() if t + self.rules.fresh_us >= now}

    def event(self, ts: int, number: int, kind: str, key: str | None, signalled: int | None, entered: int | None, net: float | None) -> Iterator[tuple]:
        """What one event does, time-outs up to it first. A close of a key that isn't open does nothing but say so; a close
        without a return ends a run of losses. A kind other than signal and close only lets time pass."""
        yield from self.expire(ts)
        if kind == "close":
            action = "closed" if key in self.open else "unknown"
            if action == "closed":
                del self.open[key]
                self.losses = self.losses + 1 if net is not None and net < 0 else 0
        elif kind == "signal":
            if key is None or signalled is None or ts - signalled > self.rules.fresh_us:
                action = "stale"
            elif key in self.taken or key in self.open:
                action = "taken"
            elif self.losses >= self.rules.losses:
                action = "paused"
            elif len(self.open) >= self.rules.slots:
                action = "full"
            else:
                action = "opened"
                self.open[key] = None if entered is None else entered + self.rules.held_us
                self.taken[key] = signalled
        else:
            return
        yield ts, number, action, key, len(self.open), self.losses


def _us(values: pd.Series) -> list[int | None]:
    """Microseconds of times, None for missing ones."""
    whole = values.astype("datetime64[us]")
    return [None if lost else int(v) for v, lost in zip(whole.astype("int64"), whole.isna(), strict=True)]


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    none = lambda values: [None if pd.isna(v) else v for v in values]
    return zip(_us(frame["ts"]), (int(v) for v in frame["event_id"]), none(frame["kind"]), none(frame["signal_key"]), _us(frame["signal_time"]), _us(frame["entry_time"]), none(frame["net_ret"]), strict=True)


def _frame(actions: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(actions, columns=["at", "event_id", "action", "signal_key", "n_open", "losses"])
    out["at"] = pd.to_datetime(out["at"], unit="us")
    out["event_id"] = out["event_id"].astype("Int64")
    return out


def _events(events: DataFrame, key: str) -> DataFrame:
    kinds = [f.rsplit(" ", 1) for f in EVENT.split(", ")]
    return events.where(F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("book"), *(F.col(n).cast(k).alias(n) for n, k in kinds))


def book_actions(events: DataFrame, key: str, rules: Rules = Rules(), until: object = None) -> DataFrame:
    """(book, at, event_id, action, signal_key, n_open, losses): what happens in each book, folded over a whole table.

    Events of a book are taken by (ts, event_id); those without a time are left out, those of a NULL book are one book. What
    is open at the end is closed if it must be by ``until``. Rows pass through a task in order and only a book's state is
    held, so its size doesn't matter; it is folded by one task, as every step needs the one before.
    """
    last = None if until is None else int(pd.Timestamp(until).value // 1000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = None
        book: Book | None = None
        for frame in frames:
            out: list[tuple] = []
            for name, row in zip(frame["book"], _rows(frame), strict=True):
                if book is None or name != now:
                    if book is not None and last is not None:
                        out += [(now, *a) for a in book.expire(last)]
                    now, book = name, Book(rules)
                out += [(name, *a) for a in book.event(*row)]
            yield _frame([a[1:] for a in out]).assign(book=[a[0] for a in out])[["book", "at", "event_id", "action", "signal_key", "n_open", "losses"]]
        if book is not None and last is not None:
            out = list(book.expire(last))
            yield _frame(out).assign(book=now)[["book", "at", "event_id", "action", "signal_key", "n_open", "losses"]]

    ordered = _events(events, key).repartition("book").sortWithinPartitions("book", "ts", "event_id")
    return ordered.mapInPandas(run, f"book string, {ACTION}")


class _LiveBook(StatefulProcessor):
    """The fold as a stateful processor: waiting events, open positions, taken keys and losses are keyed state."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, kind string, signal_key string, signal_time long, entry_time long, net_ret double")
        self.open = handle.getMapState("open", "key string", "due long")
        self.taken = handle.getMapState("taken", "key string", "at long")
        self.losses = handle.getValueState("losses", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            events = list(_rows(frame))
            self.waiting.appendList(events)
            for event in events:
                self.handle.registerTimer(-(-event[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((e for e in waiting if e[0] <= now), key=lambda e: e[:2])
        open_ = {k[0]: d[0] for k, d in self.open.iterator()} if self.open.exists() else {}
        if not ready and not any(due is not None and due <= now for due in open_.values()):
            return
        taken = {k[0]: t[0] for k, t in self.taken.iterator()} if self.taken.exists() else {}
        book = Book(self.rules, dict(open_), taken, self.losses.get()[0] if self.losses.exists() else 0)
        actions = [a for e in ready for a in book.event(*e)] + list(book.expire(now))
        later = [e for e in waiting if e[0] > now]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        self.open.clear()
        for k, due in book.open.items():
            self.open.updateValue((k,), (due,))
            if due is not None and k not in open_:
                self.handle.registerTimer(-(-due // 1000))
        self.taken.clear()
        for k, at in book.taken.items():
            self.taken.updateValue((k,), (at,))
        self.losses.update((book.losses,))
        yield _frame(actions).assign(book=key[0])[["book", "at", "event_id", "action", "signal_key", "n_open", "losses"]]

    def close(self) -> None:
        pass


def live_book(events: DataFrame, key: str, rules: Rules = Rules(), late: str = "2 hours") -> DataFrame:
    """The actions of ``book_actions`` over a stream of events, given out once the watermark, ``late`` behind the newest event,
    has passed them. Needs the RocksDB state store. Events that come later than the watermark are left out."""
    waiting = _events(events, key).withWatermark("ts", late)
    return waiting.groupBy("book").transformWithStateInPandas(_LiveBook(rules), f"book string, {ACTION}", "append", "eventtime")
