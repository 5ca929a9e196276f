"""Structured Streaming: sticky states, acknowledged batches and windowed availability."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallystone.operators.grouping import last_wins
from tallystone.sources.tables import working_dir


#: What of a key's events decides its state: the last one, the last sticky one and the last that releases.
_EVENT = ("ts", "event_id", "event_type")


class StickyStates(StatefulProcessor):
    """Per key: once sticky, only ``releases`` replaces it; events count in their own order, however late they come.

    The state is three events, and input is read frame by frame, so no key's events are gathered.
    """

    def __init__(self, sticky: str = "error", releases: str = "signup") -> None:
        self.sticky, self.releases = sticky, releases

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{n}_ts timestamp, {n}_id long, {n}_type string" for n in ("last", "stuck", "freed")))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None,) * 9
        last, stuck, freed = (held[n : n + 3] if held[n + 1] is not None else None for n in (0, 3, 6))
        later = lambda a, b: b if a is None or tuple(b[:2]) > (pd.Timestamp(a[0]), a[1]) else a
        for frame in rows:
            for event in deciding(frame, self.sticky, self.releases)[list(_EVENT)].itertuples(index=False, name=None):
                last = later(last, event)
                stuck = later(stuck, event) if event[2] == self.sticky else stuck
                freed = later(freed, event) if event[2] == self.releases else freed
        self.state.update(tuple(x for e in (last, stuck, freed) for x in (e or (None, None, None))))
        is_stuck = stuck is not None and (freed is None or (pd.Timestamp(stuck[0]), stuck[1]) > (pd.Timestamp(freed[0]), freed[1]))
        yield pd.DataFrame({"user_id": [key[0]], "state": [self.sticky if is_stuck else last[2]], "last_attempt": [last[2]]})

    def close(self) -> None:
        pass


def deciding(frame: pd.DataFrame, sticky: str, releases: str) -> pd.DataFrame:
    """Of a frame of events, each user's last one, last sticky one and last releasing one."""
    along = frame.sort_values(["ts", "event_id"])
    kinds = (along, along[along.event_type == sticky], along[along.event_type == releases])
    return pd.concat([k.groupby("user_id").tail(1) for k in kinds]).drop_duplicates()


def sticky_stream(events: DataFrame, sticky: str = "error", releases: str = "signup") -> DataFrame:
    """user_id, state, last_attempt after each batch of a stream (event_id, ts, user_id, event_type).

    Before the shuffle each task keeps three events per user and frame, so that a user with a third
    of all events sends only a few rows to its state.
    """

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield deciding(frame, sticky, releases)

    kept = events.select("event_id", "ts", "user_id", "event_type")
    return kept.mapInPandas(combine, kept.schema).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=StickyStates(sticky, releases), outputStructType="user_id long, state string, last_attempt string", outputMode="Update", timeMode="None"
    )


def run_available(stream: DataFrame, checkpoint: str, write_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there and stops. A batch is acknowledged only after write_batch returns, so
    write_batch must give the same table when it is repeated for one batch number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write_batch).start()
    query.awaitTermination()


def sticky_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Streams the events files at a path to their end and returns the latest state of each user.

    Each batch writes the states it changed under its own number, so that a repeated batch replaces
    its files; the newest state of a user wins.
    """
    folder = working_dir(spark)
    schema = spark.read.parquet(path).schema
    # A stream takes a folder or a pattern; this pattern matches the path itself and no neighbour of it.
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/states/n={number}")

    name = "spark.sql.streaming.stateStore.providerClass"  # stateful processors need this store; the session gets its own back
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_available(sticky_stream(events), f"{folder}/checkpoint", write, mode="update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    changed = spark.read.schema("user_id long, state string, last_attempt string, batch int").parquet(f"{folder}/states/n=*")
    return last_wins(changed, ["user_id"], ["batch"]).drop("batch")


def availability(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and errors per window; works on a batch or a stream with a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select(
        F.col("window.start").alias("window_start"), "n_events", "n_errors"
    )
