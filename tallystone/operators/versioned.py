"""State tables with a revision, and migrations that each run once.

A row of state carries the revision of the rules that made it. A migration says which older rows its rules
make void; these are dropped, so that their keys are worked on again, and what stays is carried over to the
new revision. Applied migrations are recorded with the state, in one published generation, so that none
runs twice, none is left out, and a failure between two of them loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources import generations


@dataclass(frozen=True)
class Migration:
    """revision: the one that it leads to. voids: rows of older revisions whose results do not hold any more."""

    revision: int
    voids: Column
    reason: str = ""


def migrate(state: DataFrame, migrations: list[Migration], applied: list[int] = ()) -> tuple[DataFrame, list[int]]:
    """state (revision and more) at the newest revision, and all revisions that were applied so far.

    Migrations are cumulative and run in the order of their revisions, each on the rows of older
    revisions only: a row that was made anew since is not dropped again.
    """
    done = sorted(set(applied))
    for m in sorted(migrations, key=lambda m: m.revision):
        if m.revision in done:
            continue
        older = F.coalesce(F.col("revision") < m.revision, F.lit(True))
        state = state.filter(~(older & F.coalesce(m.voids, F.lit(False)))).withColumn("revision", F.when(older, F.lit(m.revision)).otherwise(F.col("revision")).cast("int"))
        done.append(m.revision)
    return state, sorted(done)


class StateTable:
    """A keyed state table at a path, with the revisions that were applied to it."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{schema}, revision int, applied array<int>"

    def _stored(self) -> DataFrame:
        return generations.read_published(self.spark, self.path, self.schema)

    def read(self) -> DataFrame:
        """The state; the record of migrations is a row without a key."""
        return self._stored().filter(F.col(self.key).isNotNull()).drop("applied")

    def applied(self) -> list[int]:
        row = self._stored().filter(F.col(self.key).isNull()).select("applied").first()
        return list(row.applied) if row else []

    def _publish(self, state: DataFrame, applied: list[int]) -> None:
        record = self.spark.createDataFrame([(applied,)], "applied array<int>")
        rows = state.withColumn("applied", F.lit(None).cast("array<int>")).unionByName(record, allowMissingColumns=True)
        generations.publish(rows.select(*self.spark.createDataFrame([], self.schema).columns), self.path, least_rows=1)

    def migrate(self, migrations: list[Migration]) -> list[int]:
        """Applies what was not applied yet; returns the new revisions. Nothing is written where there are none."""
        before = self.applied()
        state, after = migrate(self.read(), migrations, before)
        new = [r for r in after if r not in before]
        if new:
            self._publish(state, after)
        return new

    def record(self, results: DataFrame, revision: int) -> None:
        """Results of one revision (key and value columns, one row per key) replace the rows of their keys, unless those are of a newer revision."""
        held = self.read()
        newer = held.filter(F.col("revision") > revision).select(self.key)
        fresh = results.join(newer, self.key, "left_anti").withColumn("revision", F.lit(revision).cast("int"))
        self._publish(held.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh), self.applied())

    def retain(self, candidates: DataFrame) -> None:
        """Drops the state of keys that are no candidates any more."""
        self._publish(self.read().join(candidates.select(self.key).distinct(), self.key, "left_semi"), self.applied())

    def open_keys(self, candidates: DataFrame) -> DataFrame:
        """The candidates without a result: new ones, and those whose results a migration dropped."""
        return candidates.select(self.key).distinct().join(self.read().select(self.key), self.key, "left_anti")
