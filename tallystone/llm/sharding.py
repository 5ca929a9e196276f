"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard depends on the key and the number of shards alone; no ring table exists, and one more
shard takes rows only into itself. Slots number the rows of a shard without gaps.

Defined cases: a null key goes to shard 0 of any count. A null text has size 1 and checksum 0.
Repeated rows each get a slot of their own. Extra input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. Takes about ln(n_shards) rounds over the whole array."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), np.int64)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while live.size:
            shard[live] = at[live]
            state[live] = state[live] * _STEP + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            at[live] = ((shard[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
            live = live[at[live] < n_shards]
    return shard


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard of a bigint key, as int."""

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), n_shards).astype(np.int32))

    return F.when(key.isNull(), F.lit(0)).otherwise(shard_of(F.coalesce(key.cast("long"), F.lit(0))))


def shard(docs: DataFrame, n_shards: int, slot_buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text).

    Slots come in two levels, so that no shard is sorted in one task: rows are numbered within
    (shard, bucket), and a bucket starts where the counts of the earlier ones end. The table of
    counts has n_shards * slot_buckets rows whatever the input, which bounds its broadcast.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    spread = F.expr(f"(pmod(coalesce(doc_id, 0), 2147483648) * 2654435761 + text_crc32) % {slot_buckets}")
    rows = rows.withColumns({
        "shard": jump_shard(F.col("doc_id"), n_shards),
        "grown_shard": jump_shard(F.col("doc_id"), n_shards + 1),
        "bucket": spread.cast("int"),
    })
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )
