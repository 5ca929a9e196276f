"""Line dedup over levelled sorted runs.

A run is a table of line keys: a 128-bit hash, how many documents of its batches hold it, and the
owner, which is the largest doc_id holding it. Runs are bucketed and sorted by key, all into the
same buckets, so that joins between runs are merge joins without a shuffle.

Batches of documents come in falling ranges of doc_id. Each batch is reduced to its own keys and
merge-anti-joined with the runs: keys that no run holds are first sightings, and the batch's largest
doc_id is their owner for good, since later batches have smaller ids only. Known keys add counts
and no owner. When a level has ``fanout`` runs they are merged into one of the next level. All
state is in the shared folder; a run is written once and removed after it was merged.

Defined cases: a null or empty text is one empty line. A document counts once for each key,
however often it repeats the line. Rows that repeat a doc_id are one document when keys are counted,
and each row is cut by its own lines. Rows without a doc_id count one by one, never own a line unless
no row that holds it has an id, and are cut like others. Extra input columns are kept by ``rewrite``,
whatever their names, and not read otherwise.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import SPACE_CHARS, delete_path, shared_dir, unused, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Document keys for each of which a run has a bucket at least.
BUCKET_KEYS = 4_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, min_chars: int) -> Column:
    """128-bit hash of the normalised line; null for lines shorter than min_chars."""
    plain = F.btrim(F.translate(line, _UPPER, _LOWER), F.lit(SPACE_CHARS))
    return F.when(F.char_length(plain) >= min_chars, F.unhex(F.md5(plain.cast("binary"))))


def document_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """doc_id, part and key, once for each document of docs (doc_id, text) and distinct key in it.

    part is 0 for rows with an id; rows without one are dealt into many parts by their text, so
    that no later grouping by document gathers all of them.
    """
    keys = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("text")), lambda x: line_key(x, min_chars))))
    part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.explode(keys).alias("key"))
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "key"]).unionByName(rows.filter("doc_id IS NULL"))


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Runs, oldest first, as one: counts add up, and a key's owner is in the oldest run that holds it."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.alias("a").join(b.hint("merge").alias("b"), F.col("a.key") == F.col("b.key"), "full_outer")
        n = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
        return both.select(F.coalesce("a.key", "b.key").alias("key"), n.alias("n_docs"), F.coalesce("a.owner", "b.owner").alias("owner"))

    return reduce(two, runs)


class LineRuns:
    """The levelled runs of one corpus, as bucketed tables whose files are in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2, buckets: int | None = None) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._prefix, self._made = f"line_run_{uuid.uuid4().hex}", 0

    def _write(self, run: DataFrame, level: int) -> None:
        """run is dealt by key into the buckets already, so that a bucket is written by one task."""
        name = f"{self._prefix}_{self._made}"
        self._made += 1
        run.write.mode("overwrite").format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete_path(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[DataFrame]:
        """The runs, oldest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def merged(self) -> DataFrame:
        """One row per key: the counts of all runs together, and its owner."""
        return _merged(self.runs()) if any(self.levels) else self.spark.createDataFrame([], "key binary, n_docs long, owner long")

    def add(self, keys: DataFrame) -> None:
        """Adds a batch (doc_id, key) as a run of level 0 and merges full levels.

        Batches must come in falling order of doc_id: the merge anti join with the runs decides
        which keys are new, and only these get an owner from this batch.
        """
        own = keys.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        held = self.runs()
        if held:
            own = own.repartition(self.buckets, "key")
            fresh = reduce(lambda left, run: left.join(run.select("key").hint("merge"), "key", "left_anti"), held, own)
            known = own.join(fresh.select("key").hint("merge"), "key", "left_anti").withColumn("owner", F.lit(None).cast("long"))
            own = fresh.unionByName(known)
        # One task and one file for each bucket, however many partitions the joins had; a bucket is its rows' hash modulo the number of buckets.
        own = own.repartitionById(self.buckets, F.pmod(F.hash("key"), F.lit(self.buckets)))
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(_merged([self.spark.table(name) for name in full]), level + 1)
            self._drop(full)
            level += 1

    def close(self) -> None:
        """Removes the runs."""
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def falling_batches(doc_id: Column, bounds: list[int]) -> Column:
    """Number of the batch of a doc_id: 0 above the largest bound, and so on down; rows without an id are in the last."""
    out = F.when(doc_id.isNull(), F.lit(len(bounds)))
    for n, bound in enumerate(sorted(bounds, reverse=True)):
        out = out.when(doc_id > bound, F.lit(n))
    return out.otherwise(F.lit(len(bounds))).cast("int")


def rewrite(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, into: str = "__line_dedup") -> DataFrame:
    """docs with a struct column ``into`` added: n_lines, n_dropped and kept_text.

    Keys that min_docs documents hold are dropped everywhere but in their owner. The keys of all
    batches are written once, split by batch, and added to the runs in turn.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    shares = [n / batches for n in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, F.lit(1000))).first()[0] or []) if shares else []
    keyed = document_keys(docs, min_chars).withColumn("batch", falling_batches(F.col("doc_id"), bounds))
    keys = written(keyed, f"{folder}/keys", ("batch",))
    # A small corpus needs fewer buckets than the session has shuffle partitions; a large one takes all of them.
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-keys.count() // BUCKET_KEYS)))
    runs = LineRuns(spark, folder, buckets=buckets)
    try:
        for n in range(len(bounds) + 1):
            runs.add(keys.filter(F.col("batch") == n).select("doc_id", "key"))
        # Written first: its size is then known, and a join that shuffles can split a common line's rows.
        common = written(runs.merged().filter(F.col("n_docs") >= min_docs).select("key", "owner"), f"{folder}/common")
    finally:
        runs.close()
    c_id, c_part, c_own, c_lost, c_kept = unused([*docs.columns, into], "_id", "_part", "_own", "_lost", "_kept")
    lost = keys.join(common, "key").filter(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("doc_id", "part").agg(F.collect_set("key").alias(c_lost))
    lost = lost.withColumnsRenamed({"doc_id": c_id, "part": c_part})
    part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    joined = docs.withColumn(c_own, part).join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(c_id)) & (F.col(c_own) == F.col(c_part)), "left")
    gone = lambda x: F.coalesce(F.array_contains(F.col(c_lost), line_key(x, min_chars)), F.lit(False))
    lines = lines_of(F.col("text"))
    # Texts that lose no line are not taken apart again.
    kept = F.when(F.col(c_lost).isNotNull(), F.filter(lines, lambda x: ~gone(x)))
    n_lines = F.size(lines).cast("long")
    result = F.struct(
        n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.size(c_kept), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(c_kept, "\n"), F.col("text"), F.lit("")).alias("kept_text"),
    )
    return joined.withColumn(c_kept, kept).withColumn(into, result).drop(c_kept, c_lost, c_id, c_part, c_own)
