"""State per source: streams in several batches against their batch forms and plain folds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.streaming import sources

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def some_events(n, seed):
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(minutes=rnd.randint(0, 9_000)), rnd.randint(1, 4), rnd.choice(["error", "error", "view", "signup"]), float(i)) for i in range(n)]


def fold(events, length):
    """The breaker of each user, event by event."""
    out = {}
    for _, ts, user, kind, _ in sorted(events, key=lambda e: (e[1], e[0])):
        held, run, done, waiting, opened = out.get(user, (None, 0, 0, 0, 0))
        if kind == "signup":
            held, run, done = None, 0, done + 1
        elif held is not None:
            waiting += 1
        else:
            done, run = done + 1, run + 1 if kind == "error" else 0
            if run >= length:
                held, opened = ts, opened + 1
        out[user] = held, run, done, waiting, opened
    return {(u, h is not None, h, r, d, w, o) for u, (h, r, d, w, o) in out.items()}


@pytest.mark.parametrize("length", [1, 2, 3])
def test_breaker_batch_equals_fold(spark, length):
    events = some_events(120, length)
    rows = sources.breaker_batch(spark.createDataFrame(events, EVENT), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup", length)
    assert {tuple(r) for r in rows.collect()} == fold(events, length)


@pytest.mark.parametrize("n_batches", [1, 4])
def test_breaker_stream_equals_fold(spark, tmp_path, n_batches):
    """However the events are cut into batches; a hold lasts from one batch into the next."""
    events = sorted(some_events(90, 9), key=lambda e: (e[1], e[0]))
    for n in range(n_batches):
        part = events[n * len(events) // n_batches : (n + 1) * len(events) // n_batches]
        spark.createDataFrame(part[::-1], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = sources.streamed(spark, str(tmp_path / "in"), sources.breaker_stream, sources.BREAKER, "user_id")
    assert {tuple(r) for r in rows.collect()} == fold(events, 3)


def test_latest_keeps_the_newest_and_forgets(spark, tmp_path):
    """Batches out of order give the newest values; a key without news leaves the state, and comes back with its next event."""
    day = lambda n, h=0: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    batches = [
        [(1, day(1), 1, "v", 1.0), (2, day(0, 5), 1, "v", 2.0), (3, day(0), 2, "v", 3.0)],
        [(4, day(0, 9), 1, "v", 4.0), (5, day(2), 3, "v", 5.0)],  # a late one for key 1 changes nothing
        [(6, day(9), 3, "v", 6.0)],  # the watermark passes keys 1 and 2
        [(7, day(10), 3, "v", 7.0), (8, day(10), 1, "v", 8.0)],
    ]
    for part in batches:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "user_id long, ts timestamp, event_id long, value double, gone boolean"
    rows = sources.streamed(spark, str(tmp_path / "in"), lambda e: sources.latest_stream(e, "2 days", 3), schema, "user_id")
    assert {(r.user_id, r.event_id, r.value, r.gone) for r in rows.collect()} == {(1, 8, 8.0, False), (2, 3, 3.0, True), (3, 7, 7.0, False)}


class Held:
    """A state and its timers in memory, with a count of how often the state is written."""

    def __init__(self):
        self.value, self.timers, self.n_updates = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.n_updates = value, self.n_updates + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_latest_holds_a_group_of_keys_in_one_state():
    """However many keys a batch has, their state is read and written once; of a group only the keys that ran out go."""
    held, latest = Held(), sources.Latest(1000)
    latest.init(held)
    frame = pd.DataFrame({"user_id": [*range(500), 7, 7], "us": [*range(0, 5_000_000, 10_000), 9_000_000, 8_000_000], "event_id": range(502), "value": [*map(float, range(501)), None]})
    first = pd.concat(latest.handleInputRows((0,), iter([frame[:250], frame[250:]]), None))
    assert held.n_updates == 1 and len(held.timers) == 1 and len(first) == 500
    assert first[first.user_id == 7][["us", "event_id", "value", "gone"]].values.tolist() == [[9_000_000, 500, 500.0, False]]
    late = pd.concat(latest.handleInputRows((0,), iter([frame[7:8]]), None))
    assert late[["user_id", "event_id"]].values.tolist() == [[7, 500]]
    gone = pd.concat(latest.handleExpiredTimer((0,), Watermark(5980), None))
    assert sorted(gone.user_id) == sorted({*range(499)} - {7}) and gone.gone.all()
    held.timers.remove(1000)  # the engine takes away the timer that ran out
    assert held.timers == [5990]


def test_latest_of_many_keys_and_of_rows_without_one(spark, tmp_path, monkeypatch):
    """All keys in one group, the greatest numbers too; rows without a key have a latest one of their own."""
    monkeypatch.setattr(sources, "GROUPS", 1)
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    batches = [[(n, at(n), 2**62 + n % 5, "v", float(n)) for n in range(20)], [(100 + n, at(19 - n), None, "v", None if n else 0.5) for n in range(6)]]
    for part in batches:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "user_id long, ts timestamp, event_id long, value double, gone boolean"
    rows = sources.streamed(spark, str(tmp_path / "in"), lambda e: sources.latest_stream(e, "2 days", 3), schema, "user_id")
    assert {(r.user_id, r.ts, r.event_id, r.value, r.gone) for r in rows.collect()} == {(2**62 + n, at(15 + n), 15 + n, 15.0 + n, False) for n in range(5)} | {(None, at(19), 100, 0.5, False)}


def test_breaker_holds_a_group_of_sources_in_one_state():
    """However many sources a batch has, their state is read and written once; sources without news stay as they were."""
    held, breaker = Held(), sources.Breaker(2)
    breaker.init(held)
    frame = pd.DataFrame({"user_id": [*range(400)] * 2, "us": [5] * 400 + [9] * 400, "event_id": range(800), "does": [1] * 800})
    first = pd.concat(breaker.handleInputRows((0,), iter([frame[300:], frame[:300]]), None))
    assert held.n_updates == 1 and len(first) == 400 and first[["held", "us", "run", "n_done", "n_waiting", "n_opened"]].drop_duplicates().values.tolist() == [[True, 9, 2, 2, 0, 1]]
    freed = pd.concat(breaker.handleInputRows((0,), iter([pd.DataFrame({"user_id": [3, 3, 900], "us": [11, 12, 1], "event_id": [1, 2, 3], "does": [0, 2, 1]})]), None))
    assert freed[["user_id", "held", "run", "n_done", "n_waiting", "n_opened"]].values.tolist() == [[3, False, 0, 3, 1, 1], [900, False, 1, 1, 0, 0]] and freed.us.isna().all()
    again = pd.concat(breaker.handleInputRows((0,), iter([pd.DataFrame({"user_id": [4], "us": [13], "event_id": [4], "does": [0]})]), None))
    assert held.n_updates == 3 and again[["user_id", "us", "n_done", "n_waiting"]].values.tolist() == [[4, 9, 2, 1]]
