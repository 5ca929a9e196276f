"""Queues, budgets, breakers, sticky states and upserts for re-runnable batches."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_order(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The next items: a top-k, which Spark takes per task and merges."""
    return rows.orderBy(*order).limit(limit)


def status_histogram(rows: DataFrame, group: list[str], state: Column, default: str = "pending") -> DataFrame:
    return rows.withColumn("state", F.coalesce(state, F.lit(default))).groupBy(*group, "state").agg(F.count("*").alias("n"))


def breaker_runs(rows: DataFrame, key: str, order: list[str], failed: Column, length: int = 3) -> DataFrame:
    """Runs of at least length failures in a row per key: run_start, n_failures. Any other result resets."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_failed", failed).withColumn("_run", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = marked.filter("_failed").groupBy(key, "_run").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n_failures"))
    return runs.filter(F.col("n_failures") >= length).select(key, F.col(f"_first.{order[0]}").alias("run_start"), "n_failures")


def round_robin(rows: DataFrame, key: str, order: list[str], budget: int | None = None) -> DataFrame:
    """Adds turn: items of each key take turns; at most budget items of a key."""
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return turns.filter(F.col("turn") <= budget) if budget else turns


def budget_per_key(limit: int, active_keys: int) -> int:
    return max(1, limit // max(1, active_keys))


def sticky_fold(rows: DataFrame, key: str, order: list[str], state: str, sticky: str, releases: str) -> DataFrame:
    """Final state per key: once sticky, only ``releases`` replaces it; other results are last_attempt.

    As an aggregate: the state is sticky if the last sticky result is later than the last releasing
    one; otherwise it is the last result.
    """
    at = F.struct(*order)
    last = rows.groupBy(key).agg(
        F.max_by(state, at).alias("last_attempt"), F.max(F.when(F.col(state) == sticky, at)).alias("_stuck"), F.max(F.when(F.col(state) == releases, at)).alias("_freed")
    )
    stuck = F.col("_stuck").isNotNull() & (F.col("_freed").isNull() | (F.col("_stuck") > F.col("_freed")))
    return last.select(key, F.when(stuck, F.lit(sticky)).otherwise(F.col("last_attempt")).alias("state"), "last_attempt")


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace rows of state with their key; the rest stays."""
    return state.join(changes.select(key), key, "left_anti").unionByName(changes)


def retain(state: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Drops state of keys that are no longer candidates."""
    return state.join(candidates.select(key).distinct(), key, "left_semi")


def enqueue(queue: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Adds keys that the queue has not seen, as pending."""
    new = found.select(key).distinct().join(queue.select(key), key, "left_anti").withColumn("status", F.lit("pending"))
    return queue.unionByName(new, allowMissingColumns=True)


def invalidate(state: DataFrame, revision: int, affected: Column) -> DataFrame:
    """Drops affected results of older revisions, so that they are made again."""
    return state.filter(~((F.col("revision") < revision) & F.coalesce(affected, F.lit(False))))


def runnable(queue: DataFrame, holds: DataFrame, source: str) -> DataFrame:
    """Pending items of sources that are not held. A held source keeps its queue; only an operator's release resumes it."""
    return queue.filter("status = 'pending'").join(holds.select(source), source, "left_anti")


def hold_sources(holds: DataFrame, failures: DataFrame, source: str) -> DataFrame:
    """holds (source, at, reason) with those sources added that failures name; a source that is held keeps its first reason."""
    first = failures.groupBy(source).agg(F.min(F.struct("at", "reason")).alias("_f")).select(source, "_f.at", "_f.reason")
    return holds.unionByName(first.join(holds.select(source), source, "left_anti"))


def retry_once(state: DataFrame, holds: DataFrame, markers: DataFrame, marker: str, source: str, name: str, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Releases one source's hold and drops its held results, the first time that marker is seen.

    The marker is added to markers (marker), to be written with the rest, so that the same request
    never runs twice. A hold for another reason stays, and so do its results.
    """
    seen = not markers.filter(F.col("marker") == marker).isEmpty()
    if seen:
        return state, holds, markers
    hit = (F.col(source) == name) & (F.col("reason") == reason)
    released = not holds.filter(hit).isEmpty()
    again = state.filter(~((F.col(source) == name) & (F.col("status") == "held"))) if released else state
    added = markers.sparkSession.createDataFrame([(marker,)], "marker string")
    return again, holds.filter(~F.coalesce(hit, F.lit(False))), markers.unionByName(added)


def stale(checked_at: Column, now: Column, hours: int = 24) -> Column:
    """Whether a result is to be checked again: never checked, or so many hours ago."""
    return F.coalesce(checked_at <= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True))


def run_batches(step: Callable[[int], tuple[int, int]], most: int = 120, minutes: float = math.inf) -> int:
    """Runs step(number) -> (still runnable, progress made) until nothing is left or moves; at most ``most`` times.

    No step begins after ``minutes``; what is left then stays pending. Returns how many ran.
    """
    began = time.monotonic()
    for n in range(most):
        if time.monotonic() - began >= 60 * minutes:
            return n
        left, progress = step(n)
        if left <= 0 or progress <= 0:
            return n + 1
    return most
