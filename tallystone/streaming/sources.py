"""Stateful processing per source: a breaker that holds a source after a run of failures, and latest values with retention.

Each operator has a batch form, which windows and aggregates express, and a stream form, whose state is a few
values per key, kept for a group of keys together. Streamed in batches of any size, in the order of time for the breaker and in any order for
the values, the result is that of the batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallystone.operators.grouping import last_wins
from tallystone.sources.tables import working_dir
from tallystone.streaming.states import run_available

BREAKER = "user_id long, held boolean, held_at timestamp, run long, n_done long, n_waiting long, n_opened long"


def breaker_batch(events: DataFrame, key: str, order: list[str], failed: Column, releases: Column, length: int = 3) -> DataFrame:
    """key, held, held_at, run, n_done, n_waiting and n_opened: the breaker of each source after all its events.

    length failures in a row open a source's breaker. Later events are not worked on but wait,
    until one that releases closes it; any other result ends a run. held_at is the failure that opened
    a breaker that is still open, run the failures in a row since, and n_opened how often it opened.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.withColumns({"_failed": F.coalesce(failed & ~releases, F.lit(False)), "_frees": F.coalesce(releases, F.lit(False))})
    parted = marked.withColumn("_part", F.sum(F.col("_frees").cast("int")).over(upto))
    # Within the stretch after a release the first run that is long enough opens the breaker for the rest of it.
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    back = [F.coalesce(F.lag("_failed", n).over(inside), F.lit(False)) for n in range(1, length)]
    opens = F.col("_failed")
    for before in back:
        opens = opens & before
    opened = F.max(F.when(F.col("_opens"), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = parted.withColumn("_opens", opens).withColumn("_open_before", F.coalesce(opened, F.lit(0)) == 1)
    good = F.sum(F.when(~F.col("_failed"), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_run", good)
    stretch = rows.groupBy(key, "_part").agg(
        F.count_if(F.col("_open_before")).alias("waiting"), F.count_if(~F.col("_open_before")).alias("done"),
        F.min(F.when(F.col("_opens"), F.struct(*order))).alias("opened"), F.max("_run").alias("_last"),
    )
    tail = rows.filter("_failed AND NOT _open_before").groupBy(key, "_part", F.col("_run").alias("_last")).agg(F.count("*").alias("run"))
    stretch = stretch.join(tail, [key, "_part", "_last"], "left")
    last = F.max_by(F.struct("opened", F.coalesce("run", F.lit(0)).alias("run")), "_part")
    out = stretch.groupBy(key).agg(last.alias("last"), F.sum("done").alias("n_done"), F.sum("waiting").alias("n_waiting"), F.count("opened").alias("n_opened"))
    held = F.col("last.opened").isNotNull()
    return out.select(key, held.alias("held"), F.col(f"last.opened.{order[0]}").alias("held_at"), F.when(held, F.lit(length)).otherwise(F.col("last.run")).cast("long").alias("run"), "n_done", "n_waiting", "n_opened")


#: Keys are dealt into so many groups. A group's keys are one value of the state, so that a batch reads and writes
#: the state once for each group and not for each key; rows without a key are a group of their own.
GROUPS = 256

_VALUE = np.dtype([("user_id", "<i8"), ("us", "<i8"), ("event_id", "<i8"), ("value", "<f8")])


def _grouped(key: str) -> Column:
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS))).cast("int").alias("_group")


def _records(frame: pd.DataFrame, dtype: np.dtype) -> np.ndarray:
    out = np.empty(len(frame), dtype)
    for name in dtype.names:
        out[name] = frame[name].to_numpy()
    return out


def _newest(parts: list[np.ndarray]) -> np.ndarray:
    """Each user's record with the greatest time, and of these the greatest event_id."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["event_id"], rows["us"], rows["user_id"]))]
    return rows[np.append(rows["user_id"][1:] != rows["user_id"][:-1], True)] if len(rows) else rows


def _ids(group: tuple, held: np.ndarray) -> pd.array:
    """The keys of a group's rows; the rows of group -1 have none."""
    return pd.array(held["user_id"], dtype="Int64") if group[0] >= 0 else pd.array([None] * len(held), dtype="Int64")


_BREAKERS = np.dtype([("user_id", "<i8"), ("us", "<i8"), ("run", "<i8"), ("n_done", "<i8"), ("n_waiting", "<i8"), ("n_opened", "<i8")])
#: The time of a breaker that is not open, which no event has.
_CLOSED = np.iinfo(np.int64).min
#: What an event does.
_ENDS, _FAILS, _FREES = 0, 1, 2


class Breaker(StatefulProcessor):
    """The breakers of a group of sources, carried from batch to batch.

    Order decides, so a group's events of one batch are sorted together; how many files a batch has bounds them.
    """

    def __init__(self, length: int = 3) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breakers", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(self.state.get()[0] if self.state.exists() else b"", _BREAKERS)
        news = pd.concat([f[["user_id", "us", "event_id", "does"]] for f in rows]).sort_values(["user_id", "us", "event_id"])
        users, starts = np.unique(news["user_id"].to_numpy(), return_index=True)
        before = {r[0]: r[1:] for r in held[np.isin(held["user_id"], users)].tolist()}
        times, does = news["us"].tolist(), news["does"].tolist()
        changed = np.empty(len(users), _BREAKERS)
        for n, (user, lo, hi) in enumerate(zip(users.tolist(), starts.tolist(), [*starts[1:].tolist(), len(times)], strict=True)):
            changed[n] = user, *self._after(before.get(user, (_CLOSED, 0, 0, 0, 0)), times[lo:hi], does[lo:hi])
        self.state.update((np.concatenate([held[~np.isin(held["user_id"], users)], changed]).tobytes(),))
        is_held = changed["us"] != _CLOSED
        yield pd.DataFrame({"user_id": _ids(key, changed), "held": is_held, "us": pd.Series(changed["us"]).astype("Int64").where(is_held), **{c: changed[c] for c in _BREAKERS.names[2:]}})

    def _after(self, breaker: tuple, times: list[int], does: list[int]) -> tuple:
        """A source's breaker after further events, in their order."""
        held_at, run, done, waiting, opened = breaker
        for at, what in zip(times, does, strict=True):
            if what == _FREES:
                held_at, run, done = _CLOSED, 0, done + 1
            elif held_at != _CLOSED:
                waiting += 1
            else:
                done += 1
                run = run + 1 if what == _FAILS else 0
                if run >= self.length:
                    held_at, opened = at, opened + 1
        return held_at, run, done, waiting, opened

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """The value with the greatest time of each key of a group, however late events come; a key without news for long leaves the state."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "rows binary, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        news = _newest([_records(frame, _VALUE) for frame in rows])
        best = _newest([held, news])
        self._hold(best, timer)
        yield self._rows(key, best[np.isin(best["user_id"], news["user_id"])], False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        gone = self._expiry(held) <= timerValues.getCurrentWatermarkInMs()
        self._hold(held[~gone], None)  # the timer that ran out is no more
        if gone.any():
            yield self._rows(key, held[gone], True)

    def _expiry(self, held: np.ndarray) -> np.ndarray:
        return held["us"] // 1000 + self.keep_ms

    def _held(self) -> tuple[np.ndarray, int | None]:
        rows, timer = self.state.get() if self.state.exists() else (b"", None)
        return np.frombuffer(rows, _VALUE), timer

    def _hold(self, held: np.ndarray, timer: int | None) -> None:
        """A group has one timer, that of the key which runs out first."""
        first = int(self._expiry(held).min()) if len(held) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.state.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.state.update((held.tobytes(), first))

    @staticmethod
    def _rows(key: tuple, held: np.ndarray, gone: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": _ids(key, held), "us": held["us"], "event_id": held["event_id"], "value": held["value"], "gone": gone})

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, failed: str = "error", releases: str = "signup", length: int = 3) -> DataFrame:
    """BREAKER rows of the sources that a batch of events (event_id, ts, user_id, event_type) changed."""
    does = F.when(F.col("event_type") == releases, _FREES).when(F.col("event_type") == failed, _FAILS).otherwise(_ENDS).alias("does")
    rows = events.select(_grouped("user_id"), F.coalesce("user_id", F.lit(0)).alias("user_id"), F.unix_micros("ts").alias("us"), "event_id", does)
    schema = BREAKER.replace("held_at timestamp", "us long")
    out = rows.groupBy("_group").transformWithStateInPandas(statefulProcessor=Breaker(length), outputStructType=schema, outputMode="Update", timeMode="None")
    return out.select("user_id", "held", F.timestamp_micros("us").alias("held_at"), "run", "n_done", "n_waiting", "n_opened")


def latest_stream(events: DataFrame, late: str, keep_days: float) -> DataFrame:
    """user_id, ts, event_id, value and gone of the keys that a batch changed or that ran out.

    late bounds how far events come out of order; a key leaves the state once the watermark has passed its last event by keep_days.
    """
    rows = events.filter("ts IS NOT NULL").select(_grouped("user_id"), F.coalesce("user_id", F.lit(0)).alias("user_id"), "ts", F.unix_micros("ts").alias("us"), "event_id", "value").withWatermark("ts", late)
    schema = "user_id long, us long, event_id long, value double, gone boolean"
    out = rows.groupBy("_group").transformWithStateInPandas(statefulProcessor=Latest(int(keep_days * 86_400_000)), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return out.select("user_id", F.timestamp_micros("us").alias("ts"), "event_id", "value", "gone")


def streamed(spark: SparkSession, batches: str, stream: object, schema: str, key: str, files_per_batch: int = 1) -> DataFrame:
    """The last row of each key that a stream over the files in a folder put out, batch by batch in the order of the files' times.

    stream turns the events into the stream's rows. Batches are written under their numbers, so a repeated one replaces itself.
    """
    folder = working_dir(spark)
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("maxFilesPerTrigger", files_per_batch).parquet(batches)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    name = "spark.sql.streaming.stateStore.providerClass"  # stateful processors need this store; the session gets its own back
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_available(stream(events), f"{folder}/checkpoint-{uuid.uuid4().hex}", write, mode="update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    changed = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out/n=*")
    return last_wins(changed, [key], ["batch"]).drop("batch")
